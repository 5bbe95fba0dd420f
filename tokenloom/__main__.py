"""Command line of the engine.

    python -m tokenloom check --bundle FOLDER_OR_NAME [--names FILE]
    python -m tokenloom migrate --source FOLDER --source-sha256 DIGEST --bundle FOLDER_OR_NAME --output FOLDER ...

Bundles hold Parquet (pieces, base, row_map) and may hold a manifest.json, whose
file digests are checked then. A file of names maps short names to
{"path": ..., "manifest_sha256": ...}; the second part pins the manifest. A
source holds params (key, row_id, vec); its digest is that of readers.folder_digest.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import SparkSession

from tokenloom import bundles
from tokenloom.operators import checks, parameters
from tokenloom.sources import readers, writers

# The errors that end a command with status 1 and a line on stderr.
FAILURES = (ValueError, OSError, RuntimeError, ImportError)


class Outcome(NamedTuple):
    status: int
    text: str


def _bundle(spark: SparkSession, options: argparse.Namespace) -> bundles.Bundle:
    path, pinned = readers.named_bundle(spark, options.names, options.bundle)
    return bundles.opened(spark, path, pinned)


def _inspect(spark: SparkSession, options: argparse.Namespace) -> dict:
    """What a bundle holds, once all that must hold of it does."""
    return _bundle(spark, options).described()


def _move(spark: SparkSession, options: argparse.Namespace) -> dict:
    """Move parameters to a bundle's ids and write them with a report."""
    if writers.exists(spark, options.output):
        raise ValueError(f"{options.output} exists")
    if (found := readers.folder_digest(spark, options.source)) != options.source_sha256:
        raise ValueError(f"the digest of {options.source} is {found}")
    bundle = _bundle(spark, options)
    params = spark.read.parquet(f"{options.source}/params")
    checks.strict(checks.value_faults(params), "parameters that are not finite")
    done = bundle.migrated(params, options.max_new_mass_ratio, tuple(options.vocabulary_key), tuple(options.bias_key))
    writers.parameters(done.params, f"{options.output}/params")
    writers.vocabulary_text(bundle.pieces, f"{options.output}/vocabulary")
    writers.report(done.report, f"{options.output}/report")
    left_out = [r.asDict() for r in done.left_out.collect()]
    return parameters.plain(done.report.first().asDict()) | {"seed": options.seed, "left_out": left_out}


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tokenloom", description="Inspect bundles and move parameters to their ids.")
    jobs = parser.add_subparsers(required=True, metavar="COMMAND")

    def job(name: str, work: Callable) -> argparse.ArgumentParser:
        own = jobs.add_parser(name, help=work.__doc__)
        own.set_defaults(job=work)
        own.add_argument("--bundle", required=True, help="a folder, or a name of the file of names")
        own.add_argument("--names", help="a JSON file of named bundles")
        return own

    job("check", _inspect)
    move = job("migrate", _move)
    move.add_argument("--source", required=True)
    move.add_argument("--source-sha256", required=True, help="the digest that the source must have")
    move.add_argument("--output", required=True, help="a folder that does not exist yet")
    move.add_argument("--vocabulary-key", action="append", default=[], help="parameters with a row for each slot; repeat")
    move.add_argument("--bias-key", action="append", default=[], help="those of them that are biases")
    move.add_argument("--max-new-mass-ratio", type=float, default=0.05)
    move.add_argument("--seed", type=int, default=0, help="noted in the report; nothing here is drawn by chance")
    return parser


def attempted(work: Callable[[], dict]) -> Outcome:
    """The result as JSON, or what went wrong in one line."""
    try:
        return Outcome(0, json.dumps(work(), ensure_ascii=False, indent=2))
    except FAILURES as error:
        return Outcome(1, f"tokenloom: {error}")


def main(argv: list[str] | None = None) -> int:
    options = _arguments().parse_args(argv)
    done = attempted(lambda: options.job(SparkSession.builder.appName("tokenloom").getOrCreate(), options))
    print(done.text, file=sys.stderr if done.status else sys.stdout)
    return done.status


if __name__ == "__main__":
    sys.exit(main())
