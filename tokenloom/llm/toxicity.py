"""Toxicity scores by a factorization machine over hashed terms (operator 3).

Terms are the lower-cased words and their first four and six bytes, hashed to
2**TERM_BITS buckets. The machine has a weight and factors for every bucket
that occurs, but only evidence moves them off zero. Rounds of score tests look
at all of them: each term against what the machine leaves unexplained, and
pairs of terms along the leading directions of the unexplained co-occurrence,
found by power iteration, so that a pair counts whose terms tell nothing by
themselves. Terms that pass are fitted in minibatches with those of the rounds
before, until a round finds no more.

It is fitted on at most `train_rows` labelled documents of at most TRAIN_TERMS
terms in all (documented bounds): those whose ids hash lowest, leaving out the
ones that would exceed the second bound. Every document is scored on its whole
text.

Null and empty texts have no term and score as the bias says. Null labels and
labels of unknown documents teach nothing; several labels of one id count as
their maximum. Without any labelled row each score is 0.5. Repeated rows score
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common, words

TERM_BITS = 22
TRAIN_ROWS = 12_000
TRAIN_TERMS = 16_000_000
PREFIXES = (4, 6)
#: Standard errors by which a term, or a pair of terms, must be off to be learnt.
TERM_ERRORS, PAIR_ERRORS = 2.5, 5.0
#: Directions looked along, and the share of the largest loading that makes a term a candidate.
DIRECTIONS, LOADING = 4, 0.3
#: Columns of one block of the pair test.
BLOCK = 512


@dataclass
class Machine:
    """A fitted factorization machine; terms are bucket numbers, ascending."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents given distinct (document, bucket) pairs."""
        out = np.full(n, self.bias)
        if not len(self.terms):
            return out
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == term
        doc, at = doc[hit], at[hit]
        out += np.bincount(doc, weights=self.weight[at], minlength=n)
        for f in self.factor.T:
            v = f[at]
            s = np.bincount(doc, weights=v, minlength=n)
            out += 0.5 * (s * s - np.bincount(doc, weights=v * v, minlength=n))
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def term_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs of a batch."""
    flat, offsets = common.flat_text(texts)
    flat = words.lowered(flat)
    starts, ends, by_doc = words.spans(flat, offsets, words.ALNUM)
    doc = np.repeat(np.arange(len(texts)), np.diff(by_doc))
    parts, docs = [words.span_hashes(flat, starts, ends)], [doc]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        parts.append(words.mix(words.span_hashes(flat, starts[long], starts[long] + k) + np.uint64(k)))
        docs.append(doc[long])
    bucket = (np.concatenate(parts) >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    pair = np.unique((np.concatenate(docs) << TERM_BITS) | bucket)
    return pair >> TERM_BITS, pair & ((1 << TERM_BITS) - 1)


class _Sample:
    """Training documents as (row, column) pairs over all distinct buckets, by row and by column."""

    def __init__(self, rows: list[np.ndarray]):
        self.n, self.size = len(rows), np.array([len(r) for r in rows])
        self.terms, self.col = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True)
        self.row = np.repeat(np.arange(self.n), self.size)
        self.m = len(self.terms)
        order = np.argsort(self.col, kind="stable")
        self.row_by_col, self.col_at = self.row[order], np.searchsorted(self.col[order], np.arange(self.m))
        self.some = np.flatnonzero(self.size)
        self.row_at = (np.cumsum(self.size) - self.size)[self.some]

    def by_term(self, value: np.ndarray) -> np.ndarray:
        """Sums of the documents' values over the documents of each term."""
        return np.bincount(self.col, weights=value[self.row], minlength=self.m)

    def among(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in chosen) of the pairs whose column is chosen (ascending)."""
        at = np.searchsorted(chosen, self.col)
        at[at == len(chosen)] = 0
        hit = chosen[at] == self.col if len(chosen) else np.zeros(len(at), dtype=bool)
        return self.row[hit], at[hit]

    def directions(self, err: np.ndarray, k: int, rng, rounds: int = 6) -> np.ndarray:
        """Leading directions of sum_d err_d x_d x_d' / |d| off its diagonal, one column each."""
        share = (err / np.maximum(self.size, 1)).astype(np.float32)
        own = self.by_term(share).astype(np.float32)
        v = np.linalg.qr(rng.normal(size=(self.m, k)).astype(np.float32))[0]
        for _ in range(rounds):
            through = np.zeros((self.n, k), dtype=np.float32)
            through[self.some] = np.add.reduceat(v[self.col], self.row_at, axis=0)
            through *= share[:, None]
            v = np.linalg.qr(np.add.reduceat(through[self.row_by_col], self.col_at, axis=0) - own[:, None] * v)[0]
        return v

    def pairs(self, chosen: np.ndarray, err: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Those of the chosen terms that some pair of them leaves unexplained by over PAIR_ERRORS."""
        row, at = self.among(chosen)

        def block(a: int) -> np.ndarray:
            x = np.zeros((self.n, min(BLOCK, len(chosen) - a)), dtype=np.float32)
            here = (at >= a) & (at < a + BLOCK)
            x[row[here], at[here] - a] = 1
            return x

        found = np.zeros(len(chosen), dtype=bool)
        for a in range(0, len(chosen), BLOCK):
            x = block(a)
            for b in range(a, len(chosen), BLOCK):
                y = block(b)
                z = np.abs((x * err[:, None]).T @ y) / np.sqrt((x * spread[:, None]).T @ y + 0.25)
                if a == b:
                    np.fill_diagonal(z, 0)
                i, j = np.nonzero(z > PAIR_ERRORS)
                found[a + i] = found[b + j] = True
        return chosen[found]


def _fitted(sample: _Sample, active: np.ndarray, par: list[np.ndarray], y: np.ndarray, epochs: int, rng, rate: float = 0.02) -> tuple[list[np.ndarray], np.ndarray]:
    """Bias, weights and factors of the active terms after some epochs of Adam, and all documents' logits."""
    n, decay = sample.n, (0.0, 1e-3, 1e-3)
    row, place = sample.among(active)
    cuts = np.searchsorted(row, np.arange(n + 1))
    one, two, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    batch = min(256, max(8, n // 20))
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            pick = order[a : a + batch]
            size = cuts[pick + 1] - cuts[pick]
            x = np.zeros((len(pick), len(active)), dtype=np.float32)
            x[np.repeat(np.arange(len(pick)), size), place[common.ragged(size, cuts[pick])]] = 1
            w0, w, v = par
            s = x @ v
            z = w0[0] + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))
            err = ((sigmoid(z) - y[pick]) / len(pick)).astype(np.float32)
            through = x.T @ err
            grads = [np.array([err.sum()]), through, x.T @ (err[:, None] * s) - v * through[:, None]]
            step += 1
            for i, g in enumerate(grads):
                g = g + decay[i] * par[i]
                one[i] = 0.9 * one[i] + 0.1 * g
                two[i] = 0.999 * two[i] + 0.001 * g * g
                par[i] = (par[i] - rate * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    w0, w, v = par
    logit = float(w0[0]) + np.bincount(row, weights=w[place], minlength=n)
    for f in v.T:
        s = np.bincount(row, weights=f[place], minlength=n)
        logit += 0.5 * (s * s - np.bincount(row, weights=(f * f)[place], minlength=n))
    return par, logit


def fit(rows: list[np.ndarray], label: np.ndarray, factors: int = 8, epochs: int = 25, seed: int = 7, rounds: int = 6) -> Machine:
    """Fit a machine on documents given as arrays of distinct buckets, and their 0/1 labels."""
    n = len(rows)
    if not n:
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, factors)))
    y = label.astype(np.float64)
    prior = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    active = np.zeros(0, np.int64)
    par = [np.array([bias], np.float32), np.zeros(0, np.float32), np.zeros((0, factors), np.float32)]
    sample, logit, rng = _Sample(rows), np.full(n, bias), np.random.default_rng(seed)
    for _ in range(rounds if sample.m else 0):
        p = sigmoid(logit)
        err = y - p
        # no label counts as surer than labels are on the whole, or else wrong ones would make terms stand out
        spread = np.maximum(err * err, prior * (1 - prior))
        single = np.flatnonzero(np.abs(sample.by_term(err)) > TERM_ERRORS * np.sqrt(sample.by_term(spread) + 0.25))
        along = sample.directions(err, min(DIRECTIONS, sample.m), rng)
        loading = np.abs(along) / np.maximum(np.abs(along).max(0), 1e-30)
        paired = sample.pairs(np.flatnonzero((loading >= LOADING).any(1)), err, spread)
        new = np.setdiff1d(np.union1d(single, paired), active)
        if not len(new):
            break
        start = rng.normal(0, 0.02, (len(new), factors)).astype(np.float32)
        # terms of pairs start out along the directions that show them
        k = min(along.shape[1], factors)
        start[:, :k] += np.where(np.isin(new, paired)[:, None], 0.3 * along[new, :k] / np.maximum(np.abs(along[:, :k]).max(0), 1e-30), 0)
        active = np.concatenate([active, new])
        order = np.argsort(active)
        active = active[order]
        par = [par[0], np.concatenate([par[1], np.zeros(len(new), np.float32)])[order], np.concatenate([par[2], start])[order]]
        par, logit = _fitted(sample, active, par, y, epochs if n >= 2000 else epochs * 4, rng)
    return Machine(sample.terms[active], float(par[0][0]), par[1].astype(np.float64), par[2].astype(np.float64))


def labelled_terms(docs: DataFrame, labels: DataFrame, label_col: str, train_rows: int, keep=None) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and labels of at most train_rows labelled documents, those whose ids hash lowest."""
    known = common.renamed(labels, doc_id="doc_id", label=label_col).where("doc_id is not null and label is not null")
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = common.lowest_hashes(known, known.count(), train_rows, "doc_id")

    def work(batches):
        for part in common.text_slices(batches, "text"):
            doc, bucket = term_pairs(part.column("text"))
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
            raw = bucket.astype("<i4").tobytes()
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label").cast(pa.int32()), "terms": pa.array([raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])], pa.binary())})

    rows = common.renamed(docs, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = common.cut(rows.transform(common.batches, work, f"doc_id {kind}, label int, terms binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("terms").alias("terms")))
    sizes = found.select("doc_id", (F.length("terms") / 4).cast("long").alias("n")).orderBy(F.xxhash64("doc_id")).collect()
    held, out = 0, []
    for r in sizes:
        if held + r.n > TRAIN_TERMS:
            out.append(r.doc_id)
        else:
            held += r.n
    if out:
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in out], f"doc_id {kind}")), "doc_id", "left_anti")
    got = found.toArrow().sort_by("doc_id")
    return [np.frombuffer(t, dtype="<i4") for t in got["terms"].to_pylist()], np.array(got["label"].to_pylist(), dtype=np.int64)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches):
        for part in common.text_slices(batches, "text"):
            doc, bucket = term_pairs(part.column("text"))
            z = shared.value.logits(doc, bucket, part.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(sigmoid(z))})

    rows = common.renamed(docs, doc_id="doc_id", text="text")
    return rows.transform(common.batches, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(modulus: int, remainder: int):
    """Whether the crc32 of an id, as text, leaves this remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled two thirds by crc32 of the id."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    rows, label = labelled_terms(docs, labels, "toxic", TRAIN_ROWS, ~held_out(3, 1))
    scored = score(docs, fit(rows, label))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
