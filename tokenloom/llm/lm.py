"""Language-model scores from a log-bilinear model (operator 7).

Tokens are lower-cased words and one end per document. The counts of all
training tokens are made in Spark; the `head` most frequent are broadcast (a
fixed bound), the rest stay a table that rare tokens are joined with.

The model is over units: the end, the most frequent words one each, and all
other words by a hash of their first four bytes, half of the units each way.
There are an eighth as many units as distinct words, MOST_UNITS at most (a
documented bound). Units are dealt into classes by rank, and

    log P(unit | context) = log softmax over classes (R . q + b) + log softmax over the class's units (r . q + b)
    q = sum_j c_j * r(unit j places before)

both normalised exactly by batched matrix products, so a token costs about
twice the root of the units. A word that shares its unit has the share
(count + 0.1) / (their total + 0.1 * (their number + 1)) of its probability, so
the model is normalised over all words and an unseen one in each shared unit.

The parameters are found by noise-contrastive estimation in numpy, for both
steps: a start on the driver from WARM_DOCS documents of at most WARM_CHARS
characters, then every task goes once over all training tokens it holds, and
what a unit has learnt is averaged by how often each task met it. Such averages
depend a little on how rows fall into tasks, and so do scores; the base score,
counts and the normalisation don't.

Null and empty texts are an end alone. Null ids are not held out. Repeated rows
are learnt from and scored each for itself. Without training tokens all words
are unknown and the units even. An empty table gives an empty result; other
columns are ignored; texts are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common, words

MOST_UNITS = 1 << 14
SIZE = 16
CONTEXT = 5
HEAD = 1 << 18
#: Noise classes for each minibatch, and noise units for each class of it.
NOISE, CLASS_NOISE = 32, 4
WARM_DOCS, WARM_CHARS, WARM_PASSES = 500, 100_000, 3
#: Bytes of a word that tell which unit it shares.
START = 4
#: Unit rows of one message of a task.
CHUNK = 1024
_END = np.uint64(0xE0D0000000000001)
END = 0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of their starts (16 bits), an end behind each document's words, and n + 1 offsets."""
    flat, offsets = common.flat_text(texts)
    flat = words.lowered(flat)
    starts, ends, by = words.spans(flat, offsets)
    start = (words.span_hashes(flat, starts, np.minimum(ends, starts + START)) >> np.uint64(48)).astype(np.int32)
    return np.insert(words.span_hashes(flat, starts, ends), by[1:], _END), np.insert(start, by[1:], 0), by + np.arange(len(by))


@dataclass
class Vocabulary:
    """The most frequent tokens, their hashes ascending, and totals of all training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray  # unit of each
    alone: np.ndarray  # whether it is a unit's only word
    classes: int
    size: int  # units
    unit_counts: np.ndarray  # training tokens of each unit
    unit_words: np.ndarray  # distinct words of each unit
    shared: np.ndarray  # unit of each remainder of starts
    total: int
    distinct: int

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens stand, and which are there at all."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes

    def unit_of(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each token, and whether other words share it."""
        at, there = self.places(hashes)
        unit = self.shared[starts % len(self.shared)]
        shares = hashes != _END
        unit[~shares] = END
        unit[there] = self.units[at[there]]
        shares[there] = ~self.alone[at[there]]
        return unit, shares


class Model:
    """Parameters of the log-bilinear model; unit u is of class u % classes."""

    def __init__(self, word, bias, class_word, class_bias, context):
        self.word, self.bias, self.class_word, self.class_bias, self.context = word, bias, class_word, class_bias, context
        self.classes = len(class_bias)

    @classmethod
    def start(cls, counts: np.ndarray, classes: int, seed: int = 3) -> Model:
        """Unigram biases and small random vectors."""
        rng = np.random.default_rng(seed)
        share = ((counts + 1.0) / (counts.sum() + len(counts))).reshape(-1, classes)
        of_class = share.sum(0)
        draw = lambda n: rng.normal(0, 0.2, (n, SIZE)).astype(np.float32)
        return cls(draw(len(counts)), np.log(share / of_class).ravel().astype(np.float32), draw(classes), np.log(of_class).astype(np.float32), np.full((CONTEXT, SIZE), 0.5, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.word, self.bias, self.class_word, self.class_bias, self.context]

    def copy(self) -> Model:
        return Model(*(p.copy() for p in self.parts()))

    def predicted(self, rows: np.ndarray) -> np.ndarray:
        """Predicted vectors of all places but the first CONTEXT; rows holds the word vectors of all."""
        out = rows[CONTEXT - 1 : -1] * self.context[0]
        for j in range(1, CONTEXT):
            out += rows[CONTEXT - 1 - j : len(rows) - 1 - j] * self.context[j]
        return out

    def log_probability(self, units: np.ndarray, offsets: np.ndarray, most: int = 1 << 18) -> np.ndarray:
        """Normalised natural log-probabilities of all units of some documents."""
        sequence, at = padded(units, offsets)
        out = np.empty(len(units))
        for a in range(0, len(units), most):
            here = at[a : a + most]
            low = int(here[0]) - CONTEXT
            q = self.predicted(self.word[sequence[low : int(here[-1]) + 1]])[here - low - CONTEXT]
            out[a : a + most] = self._given(q, sequence[here])
        return out

    def _given(self, q: np.ndarray, units: np.ndarray, block: int = 2048) -> np.ndarray:
        """Log-probabilities of units given predicted vectors."""
        n, classes = len(units), self.classes
        of, within = units % classes, units // classes
        first, second = np.empty(n), np.empty(n)

        def part(q, table, bias, mine):
            s = q @ table
            s += bias
            # no score may make exp overflow
            np.clip(s, -80, 80, out=s)
            own = s[np.arange(len(s)), mine].astype(np.float64)
            np.exp(s, out=s)
            return own - np.log((s @ np.ones(s.shape[1], np.float32)).astype(np.float64))

        table = np.ascontiguousarray(self.class_word.T)
        for a in range(0, n, block):
            first[a : a + block] = part(q[a : a + block], table, self.class_bias, of[a : a + block])
        order = np.argsort(of.astype(np.int16), kind="stable")
        cuts = np.searchsorted(of[order], np.arange(classes + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            table, bias = np.ascontiguousarray(self.word[k::classes].T), self.bias[k::classes]
            for a in range(int(cuts[k]), int(cuts[k + 1]), block):
                some = order[a : min(a + block, int(cuts[k + 1]))]
                second[some] = part(q[some], table, bias, within[some])
        return first + second


def padded(units: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents back to back, CONTEXT ends before each, and where the units stand."""
    n = np.diff(offsets)
    out = np.full(len(units) + CONTEXT * len(n), END, dtype=np.int32)
    at = np.arange(len(units)) + np.repeat(CONTEXT * np.arange(1, len(n) + 1), n)
    out[at] = units
    return out, at


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))


def _alias(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables to draw from each row's distribution: keep a column with this probability, else take that one."""
    keep, other = np.ones(share.shape, np.float32), np.tile(np.arange(share.shape[1], dtype=np.int32), (len(share), 1))
    for r, row in enumerate(share * share.shape[1]):
        small, large = np.flatnonzero(row < 1).tolist(), np.flatnonzero(row >= 1).tolist()
        while small and large:
            a, b = small.pop(), large.pop()
            keep[r, a], other[r, a] = row[a], b
            row[b] -= 1 - row[a]
            (small if row[b] < 1 else large).append(b)
    return keep, other


def _wrong(real: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the loss that tells real words from noise words, by their scores less the noise's."""
    return -1 / (1 + np.exp(np.clip(real, -30, 30))), 1 / (1 + np.exp(-np.clip(noise, -30, 30)))


class Noise:
    """Noise distributions over classes and over the units of each class."""

    def __init__(self, counts: np.ndarray, classes: int):
        share = ((counts + 1.0) / (counts.sum() + len(counts))).reshape(-1, classes)
        of_class = share.sum(0)
        self.bounds = np.cumsum(of_class)
        self.log_class = np.log(NOISE * of_class).astype(np.float32)
        self.log_unit = np.log(CLASS_NOISE * share / of_class).ravel().astype(np.float32)
        self.keep, self.other = _alias((share / of_class).T.copy())

    def draw_classes(self, rng) -> np.ndarray:
        return np.minimum(np.searchsorted(self.bounds, rng.random(NOISE)), len(self.bounds) - 1)

    def draw_units(self, rng) -> np.ndarray:
        """CLASS_NOISE units of each class, a row each."""
        classes, n = self.keep.shape
        row, column = np.arange(classes)[:, None], rng.integers(0, n, (classes, CLASS_NOISE))
        column = np.where(rng.random(column.shape, dtype=np.float32) < self.keep[row, column], column, self.other[row, column])
        return column * classes + row


class Trainer:
    """Noise-contrastive estimation in minibatches of consecutive tokens, with Adagrad."""

    def __init__(self, model: Model, noise: Noise, rate: float = 0.4, batch: int = 4096, seed: int = 5):
        self.model, self.noise, self.rate, self.batch = model, noise, rate, batch
        self.rng = np.random.default_rng(seed)
        self.past = [np.full_like(p, 0.1) for p in model.parts()]
        self.met = np.zeros(len(model.bias))

    def learn(self, units: np.ndarray, offsets: np.ndarray) -> None:
        """One pass over the tokens of some documents."""
        sequence, at = padded(units, offsets)
        real = np.zeros(len(sequence), dtype=bool)
        real[at] = True
        for a in range(CONTEXT, len(sequence), self.batch):
            self._step(sequence[a - CONTEXT : a + self.batch], real[a : a + self.batch])

    def _move(self, k: int, grad: np.ndarray, rows=slice(None)) -> None:
        past, part = self.past[k], self.model.parts()[k]
        total = past[rows] + grad * grad
        past[rows] = total
        part[rows] -= self.rate * grad / np.sqrt(total)

    def _step(self, sequence: np.ndarray, real: np.ndarray) -> None:
        m, noise = self.model, self.noise
        here = np.flatnonzero(real)
        if not len(here):
            return
        rows = m.word[sequence]
        q = m.predicted(rows)[here]
        target = sequence[CONTEXT:][here]
        of, n = target % m.classes, len(here)
        # classes: the same noise for the whole minibatch
        drawn = noise.draw_classes(self.rng)
        mine = m.class_word[of]
        off, on = _wrong((q * mine).sum(1) + m.class_bias[of] - noise.log_class[of], q @ m.class_word[drawn].T + (m.class_bias[drawn] - noise.log_class[drawn]))
        through = off[:, None] * mine + on @ m.class_word[drawn]
        # units: the same noise for all targets of a class
        units = noise.draw_units(self.rng)
        mine, others = rows[CONTEXT:][here], m.word[units][of]
        u_off, u_on = _wrong((q * mine).sum(1) + m.bias[target] - noise.log_unit[target], np.einsum("nd,nmd->nm", q, others) + (m.bias[units] - noise.log_unit[units])[of])
        through += u_off[:, None] * mine + np.einsum("nm,nmd->nd", u_on, others)
        # sums by class of what its own row and its noise units get
        width = SIZE + 1
        parts = np.empty((n, (1 + CLASS_NOISE) * width), dtype=np.float32)
        for k, w in enumerate([off, *u_on.T]):
            np.multiply(w[:, None], q, out=parts[:, k * width : k * width + SIZE])
            parts[:, k * width + SIZE] = w
        order = np.argsort(of.astype(np.int16), kind="stable")
        begins = _runs(of[order])
        there = of[order[begins]]
        sums = np.add.reduceat(parts[order], begins, axis=0)
        g_class = np.zeros((m.classes, width), dtype=np.float32)
        g_class[there] = sums[:, :width]
        np.add.at(g_class, drawn, np.column_stack([on.T @ q, on.sum(0)]))
        # every place of the sequence as a context and as a target
        g = np.zeros((len(sequence), width), dtype=np.float32)
        full = np.zeros((len(real), SIZE), dtype=np.float32)
        full[here] = through
        for j in range(CONTEXT):
            g[CONTEXT - 1 - j : len(sequence) - 1 - j, :SIZE] += full * m.context[j]
        g[CONTEXT + here, :SIZE] += u_off[:, None] * q
        g[CONTEXT + here, SIZE] = u_off
        index = np.concatenate([sequence, units[there].ravel()])
        g = np.concatenate([g, sums[:, width:].reshape(-1, width)])
        order = np.argsort(index, kind="stable")
        begins = _runs(index[order])
        unit = index[order[begins]]
        self.met[unit] += np.diff(np.append(begins, len(order)))
        scale = np.float32(16 / n)
        g = np.add.reduceat(g[order], begins, axis=0) * scale
        g_context = np.stack([(rows[CONTEXT - 1 - j : len(rows) - 1 - j] * full).sum(0) for j in range(CONTEXT)]) * scale
        self._move(0, g[:, :SIZE], unit)
        self._move(1, g[:, SIZE], unit)
        self._move(2, g_class[:, :SIZE] * scale)
        self._move(3, g_class[:, SIZE] * scale)
        self._move(4, g_context)


def token_counts(docs: DataFrame) -> DataFrame:
    """h, s and c: the count of every distinct token hash in the texts, and the hash of its start."""

    def work(batches):
        held, size = [], 0

        def merged():
            h, first, at = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            return h, np.concatenate([x[1] for x in held])[first], np.bincount(at, weights=np.concatenate([x[2] for x in held])).astype(np.int64)

        def rows(h, s, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s), pa.array(c)], names=["h", "s", "c"])

        for part in common.text_slices(batches, "text"):
            h, s, _ = tokens(part.column("text"))
            h, first, c = np.unique(h, return_index=True, return_counts=True)
            held.append((h, s[first], c))
            size += len(h)
            if size > 1 << 20:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*merged())

    return docs.select("text").transform(common.batches, work, "h bigint, s int, c bigint").groupBy("h").agg(F.min("s").alias("s"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The commonest tokens of a count table, at most `head`."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # a histogram of counts on a log scale tells from which count on words are no more than head
    step = F.floor(F.log2("c") * 64).cast("int")
    size, least = 0, 1 << 30
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():
        size += r.n
        if size > head:
            break
        least = r.s
    top = counts.where(step >= least).orderBy(F.desc("c"), "h").toArrow()
    h, s, c = (np.asarray(top[k].combine_chunks() if top.num_rows else [], dtype=np.int64) for k in ("h", "s", "c"))
    return arranged(h.view(np.uint64), s, c, [(r.s, r.c, r.n) for r in counts.groupBy("s").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()], int(total.n or 0), int(total.v))


def arranged(h: np.ndarray, s: np.ndarray, c: np.ndarray, by_start: list[tuple[int, int, int]], total: int, distinct: int) -> Vocabulary:
    """The vocabulary of the commonest tokens (hash, start and count, by descending counts) and of all tokens' sums by start."""
    size = 1 << int(np.clip(distinct // 8, 256, MOST_UNITS)).bit_length() - 1
    classes = 1 << (size.bit_length() - 1) // 2
    words_ = np.flatnonzero(h != _END)
    own = words_[: size // 2 - 1]
    # units by rank of their counts; the end is unit 0
    left = size - 1 - len(own)
    start = np.array([x[0] for x in by_start], dtype=np.int64) % left
    count = np.bincount(start, weights=[x[1] for x in by_start], minlength=left)
    n = np.bincount(start, weights=[x[2] for x in by_start], minlength=left)
    for x in (own, np.flatnonzero(h == _END)):
        count -= np.bincount(s[x] % left, weights=c[x], minlength=left)
        n -= np.bincount(s[x] % left, minlength=left)
    whole = np.concatenate([c[own], count])
    rank = np.empty(len(whole), dtype=np.int64)
    rank[np.argsort(-whole, kind="stable")] = np.arange(1, size)
    unit_counts, unit_words = np.zeros(size), np.ones(size)
    unit_counts[rank], unit_words[rank] = whole, np.concatenate([np.ones(len(own)), n])
    unit_counts[END] = c[h == _END].sum()
    shared = rank[len(own) :]
    units, alone = shared[s % left], np.zeros(len(h), dtype=bool)
    units[own], alone[own] = rank[: len(own)], True
    units[h == _END], alone[h == _END] = END, True
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], units[order], alone[order], classes, size, unit_counts, unit_words, shared, total, distinct)


def fit(docs: DataFrame, vocab: Vocabulary, warm_docs: int = WARM_DOCS) -> Model:
    """The model for training texts."""
    model = Model.start(vocab.unit_counts, vocab.classes)
    if not vocab.total:
        return model
    spark = docs.sparkSession
    noise = Noise(vocab.unit_counts, vocab.classes)
    shared = spark.sparkContext.broadcast((vocab, noise))

    def coded(batches):
        for part in common.text_slices(batches, "text"):
            h, s, offsets = tokens(part.column("text"))
            yield shared.value[0].unit_of(h, s)[0], offsets

    def listed(batches):
        for units, offsets in coded(batches):
            raw = units.astype("<i4").tobytes()
            yield pa.RecordBatch.from_pydict({"units": pa.array([raw[4 * a : 4 * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary())})

    short = docs.select("text").where(F.length("text") <= WARM_CHARS)
    n_docs = int(vocab.unit_counts[END])
    first = common.lowest_hashes(short, n_docs, warm_docs, "text").transform(common.batches, listed, "units binary").collect()
    lists = [np.frombuffer(r, dtype="<i4") for r in sorted(bytes(r.units) for r in first)]
    if lists:
        lists = [lists[i] for i in np.random.default_rng(9).permutation(len(lists))]
        warm = Trainer(model, noise, batch=1024)
        for _ in range(WARM_PASSES):
            warm.learn(np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
    start = spark.sparkContext.broadcast(model)

    def refined(batches):
        from pyspark import TaskContext

        own = start.value.copy()
        trainer, n = Trainer(own, shared.value[1]), 0
        for units, offsets in coded(batches):
            trainer.learn(units, offsets)
            n += len(units)
        if n:
            moved = [a - b for a, b in zip(own.parts(), start.value.parts())]
            yield _messages(moved, trainer.met, n, TaskContext.get().partitionId() % 64)

    got = docs.select("text").transform(common.batches, refined, _MESSAGE)
    for keys in (("chunk", "salt"), ("chunk",)):
        got = got.repartition(*keys).transform(common.batches, _summed, _MESSAGE)
    return _moved(model, {r.chunk: r for r in got.collect()})


_MESSAGE = "chunk int, salt int, value binary, weight binary"


def _message(chunk: int, salt: int, value: np.ndarray, weight: np.ndarray) -> dict:
    return {"chunk": chunk, "salt": salt, "value": value.astype("<f8").tobytes(), "weight": weight.astype("<f8").tobytes()}


def _batch_of(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("value", pa.binary()), ("weight", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema)


def _messages(moved: list[np.ndarray], met: np.ndarray, n: int, salt: int) -> pa.RecordBatch:
    """What a task has learnt: weighted moves of its units, CHUNK at a time, and of all else as chunk -1."""
    units = np.column_stack([moved[0], moved[1]]).astype(np.float64) * met[:, None]
    out = [_message(a // CHUNK, salt, units[a : a + CHUNK].ravel(), met[a : a + CHUNK]) for a in range(0, len(units), CHUNK) if met[a : a + CHUNK].any()]
    rest = np.concatenate([x.ravel() for x in moved[2:]]).astype(np.float64) * n
    return _batch_of([*out, _message(-1, salt, rest, np.array([float(n)]))])


def _summed(batches):
    """Sums of the messages of each chunk; there are a fixed number of chunks."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            found = [np.frombuffer(r[k], dtype="<f8") for k in ("value", "weight")]
            if r["chunk"] in total:
                for a, b in zip(total[r["chunk"]], found):
                    a += b
            else:
                total[r["chunk"]] = [x.copy() for x in found]
    if total:
        yield _batch_of([_message(k, 0, *x) for k, x in sorted(total.items())])


def _moved(model: Model, found: dict) -> Model:
    """The model moved by the averages of what tasks have learnt."""
    parts = model.parts()
    for k, r in found.items():
        value, weight = np.frombuffer(r["value"], "<f8"), np.frombuffer(r["weight"], "<f8")
        if k < 0:
            at = 0
            for p in parts[2:]:
                p += (value[at : at + p.size] / weight[0]).reshape(p.shape).astype(np.float32)
                at += p.size
            continue
        rows = slice(k * CHUNK, k * CHUNK + len(weight))
        mean = value.reshape(len(weight), -1) / np.maximum(weight, 1)[:, None]
        parts[0][rows] += mean[:, :SIZE].astype(np.float32)
        parts[1][rows] += mean[:, SIZE].astype(np.float32)
    return model


def score(docs: DataFrame, vocab: Vocabulary, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; docs has doc_id, text, held_out."""
    # logs of the shares' denominators, over all words and over those of each unit
    whole = float(np.log10(vocab.total + 0.1 * (vocab.distinct + 1)))
    part = np.log10(vocab.unit_counts + 0.1 * (vocab.unit_words + 1))
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        from pyspark import TaskContext

        vocab, model = shared.value
        row = TaskContext.get().partitionId() << 40
        logs = np.log10(vocab.counts + 0.1)
        for rows in common.text_slices(batches, "text"):
            h, s, offsets = tokens(rows.column("text"))
            n = rows.num_rows
            doc = np.repeat(np.arange(n), np.diff(offsets))
            at, there = vocab.places(h)
            unit, shares = vocab.unit_of(h, s)
            log = np.zeros(len(h))
            log[there] = logs[at[there]]
            # a word beyond the head gets the log of its count from the join
            lp = model.log_probability(unit, offsets) / np.log(10) + np.where(shares, log - part[unit], 0)

            def by_doc(x):
                return np.bincount(doc, weights=x, minlength=n)

            # tokens beyond the head, each distinct one of a document once with its number
            far = np.flatnonzero(~there)
            order = far[np.lexsort((h[far], doc[far]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            cuts = pa.array(np.searchsorted(doc[order[first]], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array(row + np.arange(n)),
                    "doc_id": rows.column("doc_id"),
                    "held_out": rows.column("held_out"),
                    "n_tokens": pa.array(np.diff(offsets)),
                    "near": pa.array(by_doc(there).astype(np.int64)),
                    "base": pa.array(by_doc(np.where(there, log - whole, 0))),
                    "model": pa.array(by_doc(lp)),
                    "h": pa.ListArray.from_arrays(cuts, pa.array(h[order[first]].view(np.int64))),
                    "times": pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64))),
                }
            )
            row += n

    rows = common.cut(docs.select("doc_id", "text", "held_out").transform(common.batches, work, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, near bigint, base double, model double, h array<bigint>, times array<bigint>"))
    far = rows.select("row", F.explode(F.arrays_zip("h", "times")).alias("t")).select("row", F.col("t.h").alias("h"), F.col("t.times").alias("times"))
    # ends are beyond the head only if nothing was learnt
    log, end = F.log10(F.coalesce("c", F.lit(0)) + 0.1), int(_END.view(np.int64))
    far = (
        far.join(counts, "h", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("far"),
            F.sum(F.col("times") * (log - whole)).alias("far_base"),
            F.sum(F.when(F.col("h") != end, F.col("times") * log).otherwise(0.0)).alias("far_model"),
        )
    )
    done = rows.drop("h", "times").join(far, "row", "left").na.fill(0, ["far", "far_base", "far_model"])
    return done.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("near") + F.col("far")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("far_base")).alias("base_score"),
        (F.col("model") + F.col("far_model")).alias("score"),
    )


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the nine tenths that are not held out."""
    docs = common.renamed(common.table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)))
    training = docs.where(~F.col("held_out"))
    counts = common.cut(token_counts(training))
    vocab = vocabulary(counts)
    return score(docs, vocab, fit(training, vocab), counts)
