"""Document quality from overlapping heuristics without true labels (operator 2).

Heuristic labellers vote good, bad or nothing on every document. The counts of
all vote patterns in the corpus (at most 3**labellers rows) feed an
expectation-maximisation that estimates how often each labeller is right on
good and on bad documents. The posterior of each pattern then labels the
training documents of a hashed linear scorer, fitted on at most `train_rows`
documents of at most TRAIN_CHARS characters (documented bounds: those whose
content hashes lowest). Every document is scored on its whole text.

Null and empty texts have no word: all labellers abstain and the scorer sees
its bias alone. Repeated rows score alike, an empty table gives an empty
result, other columns are ignored, ids may be null.

The labellers know different kinds of bad documents and call nearly all good
ones good, so two things are held to be known and are not estimated freely: a
labeller is wrong on a good document with a chance of FALSE_ALARM at most, and
between 5 % and 95 % of documents are good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common, words

TRAIN_ROWS, TRAIN_CHARS = 8_000, 200_000
BITS = 16
#: A document is kept from this score on.
KEEP = 0.5
#: Most that a labeller may be held to vote bad on good documents.
FALSE_ALARM = 0.01
LABELLERS = ("symbols", "capitals", "echoes", "marks", "lines", "lengths", "sentences", "variety", "digits")
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[ord(c) for c in ".,;:?'\"()-"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = words.NOT_SPACE & ~words.ALNUM & ~_PUNCT
#: Letters, capitals and digits by class, other bytes as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = ord("A"), ord("a"), ord("a"), ord("9")


class _Batch:
    """Counts that labellers and features are made of."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        self.flat, self.offsets = common.flat_text(texts)
        self.starts, self.ends, self.by_doc = words.spans(self.flat, self.offsets)
        self.words = np.diff(self.by_doc)
        self.doc = np.repeat(np.arange(self.n), self.words)
        self.hash = words.span_hashes(self.flat, self.starts, self.ends)
        self.same = np.zeros(len(self.hash), dtype=bool)
        self.same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])

    def bytes_of(self, kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[self.flat])])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def words_with(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=flag, minlength=self.n)

    def line_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines of each document, and those that equal an earlier one of it."""
        inside = np.ones(256, dtype=bool)
        inside[10] = False
        a, b, by = words.spans(self.flat, self.offsets, inside)
        doc = np.repeat(np.arange(self.n), np.diff(by))
        distinct = np.unique(words.mix(words.span_hashes(self.flat, a, b)) ^ words.mix(doc.astype(np.uint64)), return_index=True)[1]
        return np.diff(by), np.diff(by) - np.bincount(doc[distinct], minlength=self.n)


def _ratio(a, b):
    return np.asarray(a, dtype=np.float64) / np.maximum(b, 1)


def votes(batch: _Batch) -> np.ndarray:
    """One row per document and one column per labeller: 1 good, 0 bad, -1 no opinion."""
    b, n = batch, batch.words
    ends = b.flat[b.ends - 1] if len(b.ends) else b.flat[:0]
    used = b.bytes_of(words.NOT_SPACE)
    symbols = _ratio(b.bytes_of(_SYMBOL), used)
    letters = b.bytes_of(_LETTER)
    capitals = _ratio(b.bytes_of(_UPPER), letters)
    echoes = _ratio(b.words_with(b.same), n)
    alnum = np.concatenate([[0], np.cumsum(words.ALNUM[b.flat])])
    marks = _ratio(b.words_with(alnum[b.ends] == alnum[b.starts]), n)
    lines, repeats = b.line_repeats()
    repeated = _ratio(repeats, lines)
    length = _ratio(used, n)
    stops = _ratio(b.words_with((ends == ord(".")) | (ends == ord(",")) | (ends == ord("?"))), n)
    distinct = np.bincount(b.doc[np.unique(words.mix(b.hash) ^ words.mix(b.doc.astype(np.uint64)), return_index=True)[1]], minlength=b.n)
    variety = _ratio(distinct, n)
    digits = _ratio(b.bytes_of(_DIGIT), used)

    def judge(good, bad, known):
        return np.where(known & good, 1, np.where(known & bad, 0, -1))

    some = n >= 3
    return np.stack(
        [
            judge(symbols < 0.03, symbols > 0.1, some),
            judge(capitals < 0.3, capitals > 0.6, letters >= 12),
            judge(echoes < 0.05, echoes > 0.25, some),
            judge(marks < 0.05, marks > 0.2, some),
            judge(repeated < 0.2, repeated > 0.5, lines >= 4),
            judge((length >= 2.5) & (length <= 14), (length < 1.5) | (length > 25), some),
            judge((stops > 0.03) & (stops < 0.4), (stops < 0.005) | (stops > 0.7), n >= 30),
            judge(variety > 0.35, variety < 0.15, (n >= 20) & (n <= 400)),
            judge(digits < 0.1, digits > 0.3, some),
        ],
        axis=1,
    )


def fit_labellers(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, right-vote rates (labeller x bad/good) and the share of good.

    pattern: votes, one row each; count: documents with it. The labellers know different kinds of bad
    documents, so on bad ones most of them vote good; a bad vote on a good document is held to be
    rare (FALSE_ALARM at most), or else the classes would be whichever kinds happen to agree.
    """
    k = pattern.shape[1]
    right = np.tile([0.4, 0.99], (k, 1))
    share = 0.8
    weight = count.astype(np.float64)
    post = np.full(len(pattern), share)
    for _ in range(rounds):
        good = np.where(pattern == 1, np.log(right[:, 1]), np.where(pattern == 0, np.log(1 - right[:, 1]), 0)).sum(1) + np.log(share)
        bad = np.where(pattern == 0, np.log(right[:, 0]), np.where(pattern == 1, np.log(1 - right[:, 0]), 0)).sum(1) + np.log(1 - share)
        post = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        share = float(np.clip((weight @ post + 7) / (weight.sum() + 10), 0.05, 0.95))
        for j in range(k):
            voted = pattern[:, j] >= 0
            for c, p in ((0, 1 - post), (1, post)):
                m = weight * p * voted
                hit = m @ (pattern[:, j] == c)
                # a few imagined votes keep rates off 0 and 1
                right[j, c] = np.clip((hit + 4) / (m.sum() + 5), 1 - FALSE_ALARM if c else 0.05, 0.9995 if c else 0.95)
    return post, right, share


def features(batch: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features as (document, bucket, value), grouped by document and each pair once."""
    b = batch
    shape = _SHAPE[b.flat]
    keep = np.ones(len(shape), dtype=bool)
    if len(shape) > 2:
        keep[2:] = (shape[2:] != shape[1:-1]) | (shape[2:] != shape[:-2])
    keep[b.starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    form = words.span_hashes(shape[keep], place[b.starts], place[b.ends])
    before = np.zeros_like(form)
    before[1:] = np.where(b.doc[1:] == b.doc[:-1], form[:-1], np.uint64(0))
    short = np.flatnonzero(b.ends - b.starts <= 3)
    lines, repeats = b.line_repeats()
    every = np.arange(b.n)
    has = every[b.words > 0]
    docs = [b.doc, b.doc, b.doc[short], b.doc[b.same], has]
    codes = [form, words.mix(form + words.mix(before + np.uint64(1))), words.mix(b.hash[short] + np.uint64(2)), np.full(int(b.same.sum()), 11, np.uint64) << np.uint64(50), np.full(len(has), 12, np.uint64) << np.uint64(50)]
    share = 1.0 / np.maximum(b.words, 1)
    values = [share[b.doc], share[b.doc], share[b.doc[short]], share[b.doc[b.same]], _ratio(repeats, lines)[has]]
    doc, value = np.concatenate(docs), np.concatenate(values)
    bucket = (np.concatenate(codes) >> np.uint64(64 - BITS)).astype(np.int64)
    pair, inverse = np.unique((doc << BITS) | bucket, return_inverse=True)
    return pair >> BITS, pair & ((1 << BITS) - 1), np.bincount(inverse, weights=value, minlength=len(pair))


def fit_scorer(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 150, decay: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic scorer on soft targets."""
    n = len(target)
    weight = np.zeros(1 << BITS)
    prior = (target.sum() + 1) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not n:
        return bias, weight
    one, two = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(doc, weights=weight[bucket] * value, minlength=n)
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / n
        g = np.append(np.bincount(bucket, weights=err[doc] * value, minlength=1 << BITS) + decay * weight, err.sum())
        one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
        move = 0.3 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - float(move[-1])
    return bias, weight


def _codes(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


def vote_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All vote patterns of the corpus and how many documents have each."""

    def work(batches):
        total: dict[int, int] = {}
        for part in common.text_slices(batches, "text"):
            code, n = np.unique(_codes(votes(_Batch(part.column("text")))), return_counts=True)
            for c, k in zip(code.tolist(), n.tolist()):
                total[c] = total.get(c, 0) + k
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    found = docs.select("text").transform(common.batches, work, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    code = np.array([r.code for r in found], dtype=np.int64)
    pattern = (code[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1
    return pattern.reshape(-1, len(LABELLERS)), np.array([r.n for r in found], dtype=np.int64)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[float, np.ndarray]:
    """The scorer for these documents (doc_id, text)."""
    pattern, count = vote_counts(docs)
    post, _, _ = fit_labellers(pattern, count)
    posterior = dict(zip(_codes(pattern).tolist(), post.tolist()))
    # equal contents count once, so that no copied row can fill the sample
    plain = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= TRAIN_CHARS)
    sample = common.lowest_hashes(plain, int(count.sum()), train_rows, "text")

    def work(batches):
        for part in common.text_slices(batches, "text"):
            b = _Batch(part.column("text"))
            doc, bucket, value = features(b)
            cuts = np.searchsorted(doc, np.arange(b.n + 1)).tolist()
            raw_b, raw_v = bucket.astype("<i4").tobytes(), value.astype("<f4").tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "code": pa.array(_codes(votes(b)).astype(np.int32)),
                    "bucket": pa.array([raw_b[4 * x : 4 * y] for x, y in zip(cuts, cuts[1:])], pa.binary()),
                    "value": pa.array([raw_v[4 * x : 4 * y] for x, y in zip(cuts, cuts[1:])], pa.binary()),
                }
            )

    rows = sample.transform(common.batches, work, "code int, bucket binary, value binary")
    got = rows.orderBy("bucket", "value").toArrow()
    bucket = [np.frombuffer(x, "<i4") for x in got["bucket"].to_pylist()]
    value = [np.frombuffer(x, "<f4") for x in got["value"].to_pylist()]
    target = np.array([posterior[c] for c in got["code"].to_pylist()])
    if not bucket:
        return fit_scorer(np.zeros(0, int), np.zeros(0, int), np.zeros(0), target)
    doc = np.repeat(np.arange(len(bucket)), [len(x) for x in bucket])
    return fit_scorer(doc, np.concatenate(bucket).astype(np.int64), np.concatenate(value).astype(np.float64), target)


def score(docs: DataFrame, scorer: tuple[float, np.ndarray]) -> DataFrame:
    """Every row of docs, whole, with its quality score (0 to 1, higher is better) as the last column, `quality_score` if that is free."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")
    name = common.free_name(docs.columns, "quality_score")

    def work(batches):
        bias, weight = shared.value
        for part in common.text_slices(batches, "text"):
            b = _Batch(part.column(at))
            doc, bucket, value = features(b)
            z = bias + np.bincount(doc, weights=weight[bucket] * value, minlength=b.n)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*part.schema.names, name])

    return docs.transform(common.batches, work, docs.select("*", F.lit(0.0).cast("double").alias(name)).schema)


def keep_good(docs: DataFrame, least: float = KEEP) -> DataFrame:
    """The documents whose score is at least `least`, with the columns they came with."""
    plain = docs.select("text")
    scored = score(docs, fit(plain))
    return scored.where(F.col(f"`{scored.columns[-1]}`") >= least).select(*(f"`{c}`" for c in docs.columns))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score and whether it is kept, for every document."""
    docs = common.renamed(common.table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    scored = score(docs, fit(docs.select("text")))
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP).alias("keep"))
