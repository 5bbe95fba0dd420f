"""Unigram segmentation of words, texts to ids and back.

The best path of a word has the highest sum of scores, added up from the left;
among equal sums, the lexicographically smallest ids. The distinct words of a
batch are segmented at once: a trie walks on from every character of all of
them, and the best sums go forward place by place. Words are met again and
again, so every task keeps the paths of words that it has seen, and texts are
never shuffled. A vocabulary is a broadcast of pieces (a fixed bound of
MOST_PIECES rows, checked).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as tx

MOST_PIECES = 1_000_000
#: Ids that a task remembers for the words it has met.
REMEMBERED = 5_000_000
#: How much worse than the worst piece a character without a piece scores.
UNKNOWN_COST = 10_000.0


class _Trie:
    """Pieces by their characters; node 0 is the root."""

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[float, int]] = {}
        for piece, found in pieces.items():
            node = 0
            for c in piece:
                node = children.setdefault((node, ord(c)), len(children) + 1)
            ends[node] = found
        keys = np.array([node << 21 | c for node, c in children], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.child = np.append(np.array(list(children.values()), dtype=np.int64)[order], 0)
        self.ends, self.score, self.id = np.zeros(len(children) + 1, bool), np.zeros(len(children) + 1), np.zeros(len(children) + 1, np.int32)
        for node, (score, id_) in ends.items():
            self.ends[node], self.score[node], self.id[node] = True, score, id_

    def step(self, node: np.ndarray, character: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes go on with the characters, and where those that do lead."""
        key = node << 21 | character
        at = np.searchsorted(self.keys, key)
        there = self.keys[at] == key
        return there, self.child[at[there]]


@dataclass
class Lexicon:
    """Normal pieces for one segmentation: spelling to (score, id)."""

    pieces: dict[str, tuple[float, int]]
    longest: int
    unknown: float

    @classmethod
    def of(cls, pieces: DataFrame) -> Lexicon:
        """From pieces (id, piece, score, type) of one vocabulary, checked for use."""
        rows = pieces.where("type = 1").select("piece", "score", "id").limit(MOST_PIECES + 1).collect()
        if len(rows) > MOST_PIECES:
            raise ValueError(f"a vocabulary of over {MOST_PIECES} pieces")
        return cls.from_rows([(r.piece, r.score, r.id) for r in rows])

    @classmethod
    def from_rows(cls, rows: list[tuple[str, float, int]]) -> Lexicon:
        table = {}
        for piece, score, id_ in rows:
            if not piece or score is None or not math.isfinite(score) or piece in table:
                raise ValueError(f"a piece that is empty, double or without a finite score: {piece!r}")
            table[piece] = (score, id_)
        worst = min((s for s, _ in table.values()), default=0.0)
        return cls(table, max(map(len, table), default=1), worst - UNKNOWN_COST)

    def has_inner_boundary(self) -> bool:
        """Whether some piece holds the boundary mark after its first character; words then can't be taken alone."""
        return any(tx.BOUNDARY in p[1:] for p in self.pieces)

    def _trie(self) -> _Trie:
        if not hasattr(self, "_built"):
            self._built = _Trie(self.pieces)
        return self._built

    def _edges(self, points: np.ndarray, left: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, score, id) of every piece at every place; `left` counts the characters to the word's end."""
        trie = self._trie()
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        found = []
        for n in range(1, self.longest + 1):
            there, node = trie.step(node, points[at + n - 1])
            at = at[there]
            ends = trie.ends[node]
            found.append((at[ends], np.full(int(ends.sum()), n), trie.score[node[ends]], trie.id[node[ends]]))
            if n == 1 and not strict:
                alone = np.setdiff1d(np.arange(len(points)), at[ends], assume_unique=True)
                found.append((alone, np.ones(len(alone), np.int64), np.full(len(alone), self.unknown), np.zeros(len(alone), np.int32)))
            more = left[at] > n
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found))

    def paths(self, words: list[str], strict: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of all words: their scores, how many ids each has, and the ids back to back.

        With strict, the score is NaN and there are no ids unless pieces cover the word exactly; else
        characters without a piece of their own may stand as id 0. An empty word has no path.
        """
        size = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        close = np.cumsum(size)
        place = np.arange(len(points))
        begin, length, score, id_ = self._edges(points, close[word] - place, strict)
        # a word of n characters has the nodes 0 to n
        origin = close - size + np.arange(len(words))
        source = begin + word[begin]
        target = source + length
        deep = target - origin[word[begin]]
        order = np.lexsort((target, deep))
        source, target, score, id_, deep = source[order], target[order], score[order], id_[order], deep[order]
        best, back = np.full(len(points) + len(words), -np.inf), np.full(len(points) + len(words), -1, np.int64)
        best[origin] = 0.0
        cuts = np.searchsorted(deep, np.arange(1, int(deep[-1]) + 2)) if len(deep) else [0]

        # the tree of best paths: how many ids lead to a node, the node before, and one far before (skip pointers)
        depth, up, far = np.zeros(len(best), np.int64), np.arange(len(best)), np.arange(len(best))

        def climb(node: int, to: int) -> int:
            while depth[node] > to:
                node = int(far[node]) if depth[far[node]] >= to else int(up[node])
            return node

        def smaller(one: int, other: int) -> int:
            """Of two pieces that end at one place, that whose path is the smaller: where the paths part, the pieces differ."""
            x, y = int(source[one]), int(source[other])
            low = int(min(depth[x], depth[y]))
            u, v = climb(x, low), climb(y, low)
            if u == v:
                first = back[climb(x, low + 1)] if depth[x] > low else one
                second = back[climb(y, low + 1)] if depth[y] > low else other
            else:
                while up[u] != up[v]:
                    u, v = (int(far[u]), int(far[v])) if far[u] != far[v] else (int(up[u]), int(up[v]))
                first, second = back[u], back[v]
            return one if id_[first] < id_[second] else other

        for a, z in zip(cuts[:-1], cuts[1:]):
            if a == z:
                continue
            total, node = best[source[a:z]] + score[a:z], target[a:z]
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(total, heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, z - a)))
            won = np.flatnonzero((total == top[group]) & (total > -np.inf))
            best[node[heads]] = top
            back[node[won]] = a + won
            # equal sums are rare enough to compare their paths one by one
            mine = group[won]
            for k in np.flatnonzero(mine[1:] == mine[:-1]).tolist():
                spot = node[heads[mine[k]]]
                back[spot] = smaller(a + int(won[k + 1]), int(back[spot]) if k and mine[k - 1] == mine[k] else a + int(won[k]))
            spot = node[heads[np.unique(mine)]] if len(mine) < len(heads) else node[heads]
            before = source[back[spot]]
            up[spot], depth[spot] = before, depth[before] + 1
            skip = far[before]
            far[spot] = np.where(depth[before] - depth[skip] == depth[skip] - depth[far[skip]], far[skip], before)
        last = close + np.arange(len(words))
        scores = np.where(size > 0, best[last], -np.inf)
        live = np.flatnonzero(scores > -np.inf)
        at, steps = last[live], []
        while len(live):
            edge = back[at]
            go = edge >= 0
            live, edge = live[go], edge[go]
            steps.append((live, id_[edge]))
            at = source[edge]
        whose = np.concatenate([x[0] for x in steps]) if steps else np.zeros(0, np.int64)
        ids = np.concatenate([x[1] for x in steps]) if steps else np.zeros(0, np.int32)
        # steps go from the ends of words to their beginnings
        order = np.argsort(whose[::-1], kind="stable")
        return np.where(scores > -np.inf, scores, np.nan), np.bincount(whose, minlength=len(words)), ids[::-1][order].astype(np.int32)

    def path(self, word: str, strict: bool = False) -> tuple[float, list[int]] | None:
        """Score and ids of one word's best path, None if it has none."""
        score, _, ids = self.paths([word], strict)
        return None if math.isnan(score[0]) else (float(score[0]), ids.tolist())


def merged_unknowns(ids: list[int]) -> list[int]:
    """ids in which each run of unknowns is one."""
    return [x for i, x in enumerate(ids) if x or not i or ids[i - 1]]


def segment_words(words: DataFrame, lexicon: Lexicon, strict: bool = False) -> DataFrame:
    """word, score and path of distinct words; with strict, null where pieces do not cover a word."""
    shared = words.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches):
        for batch in batches:
            column = batch.column(0)
            score, n, ids = shared.value.paths([w or "" for w in column.to_pylist()], strict)
            none = np.isnan(score)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(none, False))
            yield pa.RecordBatch.from_pydict({"word": column, "score": pa.array(score, mask=none), "path": pa.ListArray.from_arrays(offsets, pa.array(ids))})

    return words.select("word").mapInArrow(work, "word string, score double, path array<int>")


class Encoder:
    """Ids of lists of words under one lexicon; the paths of words that were met are kept."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self._forget()

    def _forget(self) -> None:
        self.met: dict[str, int] = {}
        self.at, self.size, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 12, np.int32), 0

    def _learn(self, words: list[str]) -> None:
        _, n, ids = self.lexicon.paths(words)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.met.update(zip(words, range(len(self.met), len(self.met) + len(words))))
        self.at = np.concatenate([self.at, self.used + np.cumsum(n) - n])
        self.size = np.concatenate([self.size, n])
        self.used += len(ids)

    def ids(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lists back to back with each run of unknowns as one, and n + 1 offsets."""
        if self.used > REMEMBERED:
            self._forget()
        flat = lists.flatten().dictionary_encode()
        per_list = np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64)
        words = flat.dictionary.to_pylist()
        new = [w for w in words if w not in self.met]
        if new:
            self._learn(new)
        number = np.array([self.met[w] for w in words], dtype=np.int64)[np.asarray(flat.indices, dtype=np.int64)]
        n = self.size[number]
        total = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[number] - (total - n), n) + np.arange(int(n.sum()))]
        offsets = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(per_list)])]
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == 0) & (ids[:-1] == 0)
        again[offsets[:-1][offsets[:-1] < len(ids)]] = False
        return ids[~again], offsets - np.concatenate([[0], np.cumsum(again)])[offsets]


def with_ids(docs: DataFrame, lexicons: dict[str, Lexicon], text_col: str, keep: tuple[str, ...], rows_of: Callable, kinds: str) -> DataFrame:
    """What rows_of(batch of the columns `keep`, {profile: (ids, offsets)}) yields for every batch of texts; Arrow kinds: `kinds`."""
    if any(x.has_inner_boundary() for x in lexicons.values()):
        raise ValueError("a piece holds the boundary mark inside, so words can't be segmented alone")
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def work(batches) -> Iterator[pa.RecordBatch]:
        encoders = {name: Encoder(lexicon) for name, lexicon in shared.value.items()}
        for batch in batches:
            words = batch.column(len(keep))
            yield from rows_of(batch.select(list(keep)), {name: e.ids(words) for name, e in encoders.items()})

    rows = docs.select(*keep, tx.text_words(F.col(text_col)).alias("__words"))
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(work, f"{kept}, {kinds}")


def tokenize(docs: DataFrame, lexicons: dict[str, Lexicon], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, profile and ids of every text under each lexicon, in one pass over the texts.

    Works on streams as on tables.
    """

    def rows_of(batch, found):
        for name, (ids, offsets) in found.items():
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([name] * batch.num_rows), lists], names=[*keep, "profile", "ids"])

    return with_ids(docs, lexicons, text_col, keep, rows_of, "profile string, ids array<int>")


def nbest(words: DataFrame, lexicon: Lexicon, n: int) -> DataFrame:
    """word, place (from 1), score and path: the n best paths of distinct words that pieces cover, or as many as there are.

    Paths of equal sums stand in the order of their ids.
    """
    shared = words.sparkSession.sparkContext.broadcast(lexicon)

    def paths(word: str) -> list[tuple[float, tuple[int, ...]]]:
        pieces, longest = shared.value.pieces, shared.value.longest
        best: list[list] = [[(0.0, ())]] + [[] for _ in word]
        for e in range(1, len(word) + 1):
            here = [(score + found[0], (*ids, found[1])) for b in range(max(0, e - longest), e) if best[b] and (found := pieces.get(word[b:e])) for score, ids in best[b]]
            best[e] = heapq.nsmallest(n, here, key=lambda x: (-x[0], x[1]))
        return best[-1] if word else []

    def work(batches):
        for batch in batches:
            out = [(w, k, *p) for w in batch.column(0).to_pylist() for k, p in enumerate(paths(w or ""), 1)]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_pydict({"word": pa.array(columns[0], pa.string()), "place": pa.array(columns[1], pa.int32()), "score": pa.array(columns[2], pa.float64()), "path": pa.array([list(x) for x in columns[3]], pa.list_(pa.int32()))})

    return words.select("word").mapInArrow(work, "word string, place int, score double, path array<int>")


def sampled(docs: DataFrame, lexicon: Lexicon, alpha: float, seed: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Like tokenize, with each word's path drawn with probability proportional to exp(alpha * score).

    As no piece reaches across words, that is a draw from the lattice of the whole text.
    Draws depend on the seed, the text and the place of the word only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches):
        import random
        import zlib

        lex = shared.value
        for batch in batches:
            rows = []
            for words in batch.column(len(keep)).to_pylist():
                dice = random.Random(zlib.crc32("".join(words).encode()) * 65_537 + seed)
                ids: list[int] = []
                for w in words:
                    # forward sums, then a walk back from the end
                    n, into = len(w), [0.0] + [-math.inf] * len(w)
                    edges: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
                    for b in range(n):
                        for e in range(b + 1, min(n, b + lex.longest) + 1):
                            f = lex.pieces.get(w[b:e]) or ((lex.unknown, 0) if e == b + 1 else None)
                            if f:
                                s = alpha * f[0]
                                edges[e].append((b, f[1], s))
                                top = max(into[e], into[b] + s)
                                into[e] = top + math.log(math.exp(into[e] - top) + math.exp(into[b] + s - top))
                    back, at = [], n
                    while at:
                        options = edges[at]
                        weights = [math.exp(into[b] + s - into[at]) for b, _, s in options]
                        at, id_, _ = dice.choices(options, weights)[0]
                        back.append(id_)
                    ids += back[::-1]
                rows.append(merged_unknowns(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.list_(pa.int32()))], names=[*keep, "ids"])

    rows = docs.select(*keep, tx.text_words(F.col("text")).alias("words"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(work, f"{kinds}, ids array<int>")
