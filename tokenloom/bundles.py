"""Bundles: a profile's pieces, the base they extend and the row map between them, opened with all their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import checks, joins, parameters
from tokenloom.sources import readers, writers


@dataclass
class Moved:
    """Parameters after a migration, its report, and what was left out by key."""

    params: DataFrame
    report: DataFrame
    left_out: DataFrame


@dataclass
class Bundle:
    """Tables of one bundle: pieces and base as in vocabulary.py, row_map (source_id, target_id)."""

    pieces: DataFrame
    base: DataFrame
    row_map: DataFrame
    manifest: dict

    def blanks(self) -> tuple[int, int]:
        """The blank id of the base and that of the bundle."""
        return self.base.agg(F.max("id") + 1).first()[0], self.pieces.agg(F.max("blank_id")).first()[0]

    def verify(self) -> None:
        """A ValueError if slots, donors, row map or layout are not what they must be."""
        checks.strict(checks.profile_faults(self.pieces, self.base), "slots differ from the base")
        checks.strict(checks.donor_faults(self.pieces.where("is_active")), "pieces that can't be used")
        checks.strict(checks.row_map_faults(self.row_map, *self.blanks()), "the row map is not one")
        found = self.pieces.agg(F.max("profile").alias("profile"), F.count_if("is_active").alias("active")).first()
        spark = self.pieces.sparkSession
        wanted = spark.createDataFrame([(found.profile, int(self.manifest.get("active_vocabulary_size") or found.active))], "profile string, active long")
        checks.strict(checks.layout_faults(self.pieces, self.row_map.select(F.lit(found.profile).alias("profile"), "source_id", "target_id"), wanted), "the layout")

    def described(self) -> dict:
        """Sizes, the blank and a digest over all slots in their order."""
        found = self.pieces.agg(F.max("profile").alias("profile"), F.count("*").alias("native_vocabulary_size"), F.count_if("is_active").alias("active_vocabulary_size"), F.max("blank_id").alias("native_blank_id")).first()
        lines = joins.bounded(self.pieces.select("id", F.to_json(F.struct("id", "piece", "score", "type", "is_active")).alias("line")).orderBy("id"))
        return found.asDict() | {"structural_passed": True, "tokenizer_sha256": readers.digest_of_lines(r.line for r in lines)}

    def migrated(self, params: DataFrame, ratio: float, vocabulary_keys: tuple[str, ...], bias_keys: tuple[str, ...]) -> Moved:
        """Rows of vocabulary keys moved to this bundle's ids, added rows filled from donors, all other rows kept."""
        mapped = self.row_map.select("source_id", "target_id")
        donors = parameters.donor_pieces(self.base, mapped, self.pieces)
        paths = parameters.donor_paths(parameters.added_ids(self.pieces, mapped), donors).cache()
        loads, unit = parameters.donor_loads(paths, donors)
        checks.strict(parameters.load_faults(loads, paths, unit), "loads do not add up")
        report = parameters.donor_report(paths, loads, unit, ratio)
        ours = F.col("key").isin(*vocabulary_keys)
        vocabulary = params.where(ours)
        at_target = vocabulary.join(mapped, vocabulary.row_id == mapped.source_id).select("key", F.col("target_id").alias("row_id"), "vec")
        means = parameters.donor_means(at_target, paths, donors)
        shift = report.first().shift
        if shift is not None:
            raised = F.transform("vec", lambda x: parameters.shifted_bias(x, F.lit(shift)))
            means = means.withColumn("vec", F.when(F.col("key").isin(*bias_keys), raised).otherwise(F.col("vec")))
        done = parameters.transfer(vocabulary, mapped, means)
        checks.strict(parameters.verify_transfer(vocabulary, mapped, done).where("values_changed > 0"), "values changed")
        return Moved(done.unionByName(params.where(~ours)), report, parameters.left_out(vocabulary, mapped))


def opened(spark: SparkSession, path: str, manifest_sha256: str | None = None) -> Bundle:
    """The bundle in a folder, checked; where it has a manifest, the digests of its files are too."""
    if not writers.exists(spark, path):
        raise FileNotFoundError(f"no bundle at {path}")
    manifest = readers.checked_manifest(spark, path, manifest_sha256)
    bundle = Bundle(*(spark.read.parquet(f"{path}/{name}") for name in ("pieces", "base", "row_map")), manifest)
    bundle.verify()
    return bundle
