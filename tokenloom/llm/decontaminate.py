"""Benchmark decontamination with an FM-index for each shard of documents (operator 8).

A shard (about SHARD_BYTES of text) becomes a sequence of symbols: the words
that some test item uses by number, one more number for each run of other words
and each start of a document, and a single 0 at the end. Its suffix array (rank
doubling on packed keys) gives the Burrows-Wheeler transform, kept as a wavelet
matrix. All test windows are searched backwards at once, two ranks for each
word; occurrences are located by walking to the next sampled suffix position.
The spans found are merged in each document.

Words are runs of letters, digits and non-ASCII characters, in lower case
(A-Z only). A window is `width` consecutive words of an item, or all words of a
shorter one. Null and empty texts have no words and no hits; items without
words never occur. Repeated documents are searched each for itself, equal items
of different ids all count, one id counts once. Empty tables give no rows or no
hits. Other columns of the documents pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common, words

WINDOW = 10
SHARD_BYTES = 2 << 20
SAMPLE = 8
#: Words of test items in one broadcast; more items are searched block by block.
BLOCK_WORDS = 1 << 20


@dataclass
class Patterns:
    """Distinct windows of test items over numbered words."""

    vocabulary: np.ndarray  # sorted hashes; the word at place i has number i + 1
    symbols: np.ndarray  # windows x width, zeros behind short ones
    lengths: np.ndarray
    item_at: np.ndarray  # n + 1 offsets into items
    items: np.ndarray  # item ordinals by window
    names: list[str]


def _item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    flat, offsets = common.flat_text(pa.array(texts, pa.string()))
    flat = words.lowered(flat)
    starts, ends, by = words.spans(flat, offsets, words.ALNUM)
    return words.span_hashes(flat, starts, ends), by


def patterns(ids: list, texts: list[str | None], width: int = WINDOW) -> Patterns:
    """The windows of test items."""
    hashes, by = _item_words(texts)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    number = number.astype(np.int32) + 1
    names = sorted({"" if i is None else str(i) for i in ids})
    ordinal = {name: k for k, name in enumerate(names)}
    rows, owner = [], []
    for k, (a, b) in enumerate(zip(by.tolist(), by[1:].tolist())):
        n = b - a
        if not n:
            continue
        view = np.zeros((max(1, n - width + 1), width), dtype=np.int32)
        if n >= width:
            view[:] = np.lib.stride_tricks.sliding_window_view(number[a:b], width)
        else:
            view[0, :n] = number[a:b]
        rows.append(view)
        owner.append(np.full(len(view), ordinal["" if ids[k] is None else str(ids[k])]))
    if not rows:
        return Patterns(vocabulary, np.zeros((0, width), np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), names)
    symbols, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pair = np.unique(np.stack([inverse.ravel(), np.concatenate(owner)], axis=1), axis=0)
    return Patterns(vocabulary, symbols, (symbols > 0).sum(1), np.searchsorted(pair[:, 0], np.arange(len(symbols) + 1)), pair[:, 1], names)


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Positions of all suffixes in order; behind the end stands a symbol below all others."""
    n = len(text)
    bits = max(1, int(alphabet + 1).bit_length())
    per = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(per, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(per):
        key = (key << bits) | padded[k : k + n]
    depth = per
    order = np.argsort(key)
    sorted_key = key[order]
    rank = np.empty(n + 1, dtype=np.int64)
    step = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    head = np.maximum.accumulate(np.where(step, np.arange(n), 0))
    rank[order] = head + 1
    rank[n] = 0
    # rank = 1 + first place of the group, so ranks of untied suffixes are final
    tied_place = np.flatnonzero(~step | ~np.append(step[1:], True))
    rank_bits = int(n + 1).bit_length()
    parts = max(2, 62 // rank_bits)
    while len(tied_place):
        at = order[tied_place]
        key = rank[at]
        for k in range(1, parts):
            key = (key << rank_bits) | rank[np.minimum(at + k * depth, n)]
        sub = np.argsort(key)
        at, key = at[sub], key[sub]
        order[tied_place] = at
        step = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(step, tied_place, 0))
        rank[at] = head + 1
        tied_place = tied_place[~step | ~np.append(step[1:], True)]
        depth *= parts
    return order


class FMIndex:
    """Backward search and location over a sequence of numbers from 1 to alphabet, closed by the only 0."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE):
        self.n = len(text)
        order = suffix_array(text, alphabet)
        bwt = text[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.levels, self.zeros = [], []
        self.bits = max(1, int(alphabet).bit_length())
        current = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            high = bit.astype(bool)
            current = np.concatenate([current[~high], current[high]])
        self.bwt = bwt
        sampled = order % sample == 0
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.samples = order[sampled].astype(np.int32)
        # where each symbol's run begins on the last level
        self.first = self._descend(np.arange(alphabet + 1), np.zeros(alphabet + 1, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            up = ones[place]
            place = np.where(bit == 1, zeros + up, place - up)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        return self._descend(symbol, place) - self.first[symbol]

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low, high) of the patterns that occur, as ranges of the suffix array."""
        live = np.arange(len(lengths))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        done: list[tuple] = []
        for step in range(symbols.shape[1] + 1):
            over = lengths[live] == step
            done.append((live[over], low[over], high[over]))
            live, low, high = live[~over], low[~over], high[~over]
            if not len(live):
                break
            c = symbols[live, lengths[live] - 1 - step].astype(np.int64)
            both = self.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = self.below[c] + both[: len(c)], self.below[c] + both[len(c) :]
            there = low < high
            live, low, high = live[there], low[there], high[there]
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows."""
        out = np.empty(len(row), dtype=np.int64)
        left, row, steps = np.arange(len(row)), row.copy(), 0
        while len(left):
            here = self.sampled[row]
            out[left[here]] = self.samples[self.sample_at[row[here]]] + steps
            left, row = left[~here], row[~here]
            if not len(left):
                break
            c = self.bwt[row].astype(np.int64)
            row = self.below[c] + self.rank(c, row)
            steps += 1
        return out


def blocks_of(items: DataFrame, width: int = WINDOW) -> Iterator[Patterns]:
    """The patterns of items (item_id, text), about BLOCK_WORDS words at a time; no more of them is held at once."""
    ids, texts, size = [], [], 0
    for r in common.renamed(items, item_id="item_id", text="text").orderBy("item_id").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text or "") // 4
        if size >= BLOCK_WORDS:
            yield patterns(ids, texts, width)
            ids, texts, size = [], [], 0
    if ids:
        yield patterns(ids, texts, width)


def find(texts: pa.Array, blocks: Iterable[Patterns], sample: int = SAMPLE):
    """Hits of one shard: byte starts and ends of all words, word offsets by document, hit words, (document, item name)."""
    flat, offsets = common.flat_text(texts)
    flat = words.lowered(flat)
    starts, ends, by_doc = words.spans(flat, offsets, words.ALNUM)
    hashes = words.span_hashes(flat, starts, ends)
    edge = np.zeros(len(starts) + 1, dtype=np.int64)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(by_doc))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k, p in enumerate(blocks):
        if not len(p.lengths) or not len(hashes):
            continue
        at = np.searchsorted(p.vocabulary, hashes)
        at[at == len(p.vocabulary)] = 0
        symbol = np.where(p.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
        # one break for each run of other words, and one before each document
        other = len(p.vocabulary) + 1
        keep = np.ones(len(symbol), dtype=bool)
        keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0)
        heads = by_doc[:-1][np.diff(by_doc) > 0]
        kept = np.flatnonzero(keep)
        text = np.insert(symbol[kept], np.searchsorted(kept, heads), 0)
        text[text == 0] = other
        place = np.insert(kept, np.searchsorted(kept, heads), -1)
        index = FMIndex(np.append(text, np.int32(0)), other, sample)
        which, low, high = index.search(p.symbols, p.lengths)
        size = high - low
        which = np.repeat(which, size)
        word = place[index.locate(common.ragged(size, low))]
        np.add.at(edge, word, 1)
        np.add.at(edge, word + p.lengths[which], -1)
        pair = np.unique(doc_of[word] * len(p.lengths) + which)
        doc, which = pair // len(p.lengths), pair % len(p.lengths)
        n = p.item_at[which + 1] - p.item_at[which]
        item = p.items[common.ragged(n, p.item_at[which])]
        pair = np.unique(np.repeat(doc, n) * len(p.names) + item)
        found.append((pair // len(p.names), np.array(p.names, dtype=object)[pair % len(p.names)]))
    return starts, ends, by_doc, np.cumsum(edge)[:-1] > 0, found


def search_documents(docs: DataFrame, items: DataFrame, width: int = WINDOW, text_col: str = "text", shard_bytes: int = SHARD_BYTES, clean: bool = False) -> DataFrame:
    """The rows of docs with a struct column `leak`: n_words, n_hit, n_items, items_sha256, spans.

    spans are the merged byte ranges of hit words in the UTF-8 text. With clean,
    the text comes back without them and `leak` is left away.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(p) for p in blocks_of(items, width)]
    at = docs.columns.index(text_col)
    name = common.free_name(docs.columns, "leak")
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    def gathered(batches):
        held, size = [], 0
        for part in common.text_slices(batches, batch_column, shard_bytes):
            held.append(part)
            size += part.column(at).nbytes
            if size >= shard_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    batch_column = text_col

    def work(batches):
        def blocks():
            """One block of patterns in memory at a time; only a single one is kept."""
            for b in shared:
                yield b.value if len(shared) == 1 else b.load_from_path(b._path)

        for shard in gathered(batches):
            column = shard.column(at)
            starts, ends, by_doc, hit, found = find(column, blocks())
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[by_doc[1:]] - total[by_doc[:-1]]
            runs_from = hit & ~np.concatenate([[False], hit[:-1]]) if len(hit) else hit
            runs_from[by_doc[:-1][by_doc[:-1] < len(hit)]] |= hit[by_doc[:-1][by_doc[:-1] < len(hit)]]
            runs_to = hit & ~np.concatenate([hit[1:], [False]]) if len(hit) else hit
            last = by_doc[1:][by_doc[1:] > 0] - 1
            runs_to[last] |= hit[last]
            a, b = np.flatnonzero(runs_from), np.flatnonzero(runs_to)
            run_at = np.searchsorted(a, by_doc)
            _, offsets = common.flat_text(column)
            items_of: dict[int, set[str]] = {}
            for docs_, names in found:
                for d, i in zip(docs_.tolist(), names.tolist()):
                    items_of.setdefault(d, set()).add(i)
            leaks, texts = [], column.to_pylist() if clean else []
            for d in range(shard.num_rows):
                spans = [(int(starts[x] - offsets[d]), int(ends[y] - offsets[d])) for x, y in zip(a[run_at[d] : run_at[d + 1]], b[run_at[d] : run_at[d + 1]])]
                if clean:
                    if spans:
                        raw, at_byte, kept = texts[d].encode(), 0, []
                        for x, y in spans:
                            kept.append(raw[at_byte:x])
                            at_byte = y
                        texts[d] = b"".join([*kept, raw[at_byte:]]).decode()
                    continue
                names = sorted(items_of.get(d, ()))
                leaks.append({"n_words": int(by_doc[d + 1] - by_doc[d]), "n_hit": int(n_hit[d]), "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "spans": [{"begin": x, "end": y} for x, y in spans]})
            if clean:
                columns = list(shard.columns)
                columns[at] = pa.array(texts, column.type)
                yield pa.RecordBatch.from_arrays(columns, names=shard.schema.names)
            else:
                yield pa.RecordBatch.from_arrays([*shard.columns, pa.array(leaks, kind)], names=[*shard.schema.names, name])

    if clean:
        return docs.transform(common.batches, work, docs.schema)
    leak = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, spans: array<struct<begin: bigint, end: bigint>>>"
    return docs.transform(common.batches, work, docs.select("*", F.lit(None).cast(leak).alias(name)).schema)


def remove_passages(docs: DataFrame, items: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs without the merged spans of hit words; sizes of changed texts are renewed."""
    clean = search_documents(docs, items, text_col=text_col, clean=True)
    if size_col not in docs.columns:
        return clean
    return clean.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents hold windows of benchmark items."""
    docs = common.renamed(common.table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = search_documents(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(F.col(f"leak.{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256")), (F.col("leak.n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
hits AS MATERIALIZED (
  SELECT r, i, d.n, item_id
  FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) d
  JOIN windows v ON v.n = d.n AND v.s = d.s),
hit_words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
