"""SentencePiece BPE encoding and decoding in numpy (operator 9).

Texts are cut into words at every run of spaces (no piece holds a space after
another character; that is checked when a model is loaded). The distinct words
of a batch are laid out as one flat array of symbols. Each round finds the
best-ranked pair of every word with one segmented minimum, merges its leftmost
occurrences in all words at once, compacts the arrays and ranks only the pairs
that changed, until no word has a pair left. A word whose merges would create
a pair of the same or a better rank merges only its leftmost occurrence in that
round, so the order is exactly that of a priority queue. In words that are
still not done after SETTLED rounds, places that no piece can ever reach across
become ends of words of their own, so long words need few rounds too. Words are
found by hash and compared byte by byte.

Nulls and empty texts encode to the begin and end ids alone and decode to "".
Rows are independent: repeated rows give repeated results, an empty table an
empty result, other columns are ignored. Texts of any length are encoded
whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import common, words

#: Rounds after which words are cut where nothing can merge any more.
SETTLED = 12
#: Ids and bytes that one worker keeps for words it has met.
CACHE_IDS, CACHE_BYTES = 3_000_000, 32 << 20
_NONE = np.int32(2**31 - 1)
_SPACE = "▁"


class PieceTable:
    """Arrays of one BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        byte_ids = {i for i in range(n) if sp.is_byte(i)}
        if len(byte_ids) != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("only models with byte fallback and without unused pieces")
        self.n, self.bos, self.eos = n, sp.bos_id(), sp.eos_id()
        normal = [i for i in range(n) if i not in special and i not in byte_ids]
        if any(_SPACE in pieces[i].lstrip(_SPACE) for i in normal):
            raise ValueError("a piece holds a space after another character")
        probe = "  AÄ ﬁ "
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("only models whose normaliser changes nothing")
        symbol = {pieces[i]: i for i in normal}
        for i in normal:
            for c in pieces[i]:
                symbol.setdefault(c, len(symbol) + n)
        self.width = n + len(symbol) + 1
        self.unknown = self.width - 1
        self.char_symbol = np.full(0x110000, self.unknown, dtype=np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        scores = np.array([sp.get_score(i) for i in normal])
        rank = np.unique(-scores, return_inverse=True)[1]
        keys, ranks, outs = [], [], []
        for i, k in zip(normal, rank.tolist()):
            s = pieces[i]
            for cut in range(1, len(s)):
                left, right = symbol.get(s[:cut]), symbol.get(s[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    ranks.append(k)
                    outs.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(2**62))
        self.ranks = np.append(np.array(ranks, dtype=np.int32)[order], _NONE)
        self.outs = np.append(np.array(outs, dtype=np.int32)[order], np.int32(-1))
        self._symbol, self._joints = symbol, None
        self.byte_id = np.zeros(256, dtype=np.int32)
        texts: list[bytes] = [b""] * n
        for i in byte_ids:
            b = int(pieces[i][3:-1], 16)
            self.byte_id[b] = i
            texts[i] = bytes([b])
        for i in normal:
            texts[i] = pieces[i].replace(_SPACE, " ").encode()
        texts = [b" \xe2\x81\x87 " if sp.is_unknown(i) else t for i, t in enumerate(texts)]
        self.plain = np.array([i not in special and i not in byte_ids for i in range(n)])
        self.piece_len = np.array([len(t) for t in texts], dtype=np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.cache = None

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of neighbouring symbols."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.outs[at]

    def joints(self) -> np.ndarray:
        """Pairs of symbols, ascending, that symbols which end and begin so can ever merge across."""
        if self._joints is None:
            tails, heads = [[] for _ in range(self.width)], [[] for _ in range(self.width)]
            for s, i in self._symbol.items():
                tails[i] = [j for cut in range(len(s)) if (j := self._symbol.get(s[cut:])) is not None]
                heads[i] = [j for cut in range(len(s)) if (j := self._symbol.get(s[: cut + 1])) is not None]
            keys = self.keys[:-1]
            for ends, place in ((tails, self.width), (heads, 1)):
                # every symbol on this side by each of its ends
                count = np.array([len(x) for x in ends], dtype=np.int64)
                listed = np.array([j for x in ends for j in x], dtype=np.int64)
                own = keys // place % self.width
                keys = np.repeat(keys - own * place, count[own]) + listed[common.ragged(count[own], (np.cumsum(count) - count)[own])] * place
                keys = np.unique(keys)
            self._joints = np.append(keys, np.int64(2**62))
        return self._joints

    # -- words ------------------------------------------------------------
    def merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words after all merges, and how many each word has left; no word may be empty."""
        out_sym, out_place, out_len = [], [], []
        begins = np.cumsum(lens) - lens
        place = begins  # where in the text each word, or what was cut off one, begins
        last = np.zeros(len(sym), dtype=bool)
        last[np.cumsum(lens) - 1] = True
        rank = np.full(len(sym), _NONE, dtype=np.int32)
        made = np.full(len(sym), -1, dtype=np.int32)
        inner = np.flatnonzero(~last)
        rank[inner], made[inner] = self.pairs(sym[inner], sym[inner + 1])
        rounds = 0
        while len(lens):
            rounds += 1
            if rounds > SETTLED:
                place, lens = self._cut(sym, last, place, lens)
            starts = np.cumsum(lens) - lens
            best = np.minimum.reduceat(rank, starts)
            live = best != _NONE
            if not live.all():
                keep = np.repeat(live, lens)
                out_sym.append(sym[~keep])
                out_place.append(place[~live])
                out_len.append(lens[~live])
                sym, rank, made, last = sym[keep], rank[keep], made[keep], last[keep]
                place, lens, best = place[live], lens[live], best[live]
                if not len(lens):
                    break
            of = np.repeat(np.arange(len(lens)), lens)
            at = np.flatnonzero(rank == best[of])
            run = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            merged = self._apply(sym, rank, made, last, at)
            if len(at) > len(lens):
                new_rank, changed, kept = merged[1], merged[4], merged[5]
                words_of = of[kept]
                unsafe = np.zeros(len(lens), dtype=bool)
                c_words = words_of[changed]
                unsafe[c_words[new_rank[changed] <= best[c_words]]] = True
                mine = of[at]
                leading = np.concatenate([[True], mine[1:] != mine[:-1]])
                allowed = leading | ~unsafe[mine]
                if not allowed.all():
                    at = at[allowed]
                    merged = self._apply(sym, rank, made, last, at)
            sym, rank, made, last = merged[:4]
            lens = lens - np.bincount(of[at], minlength=len(lens))
        if not out_sym:
            return sym, lens
        sym, place, length = np.concatenate(out_sym), np.concatenate(out_place), np.concatenate(out_len)
        start = np.cumsum(length) - length
        order = np.argsort(place)
        total = np.concatenate([[0], np.cumsum(length[order])])
        by_word = np.append(np.searchsorted(place[order], begins), len(place))
        return sym[common.ragged(length[order], start[order])], np.diff(total[by_word])

    def _cut(self, sym, last, place, lens):
        """Mark ends in `last` where nothing can merge across any more; the places and lengths of what is between them."""
        inner = np.flatnonzero(~last)
        key = sym[inner].astype(np.int64) * self.width + sym[inner + 1]
        joints = self.joints()
        last[inner[joints[np.searchsorted(joints, key)] != key]] = True
        ends = np.flatnonzero(last) + 1
        cut = np.diff(ends, prepend=0)
        if len(cut) == len(lens):
            return place, lens
        # characters, not symbols, tell where in the text a part begins
        wide = np.concatenate([[0], np.cumsum(self._widths(sym))])
        word = np.searchsorted(np.cumsum(lens), ends - cut, side="right")
        first = np.cumsum(lens) - lens
        return place[word] + wide[ends - cut] - wide[first[word]], cut

    def _apply(self, sym, rank, made, last, at):
        """Merge the pairs at `at`; also the positions whose pair changed, and the old positions that stay."""
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        sym, last = sym.copy(), last.copy()
        sym[at] = made[at]
        last[at] = last[at + 1]
        kept = np.flatnonzero(keep)
        sym, rank, made, last = sym[kept], rank[kept], made[kept], last[kept]
        spot = at - np.arange(len(at))  # each earlier merge moved it one place down
        before = spot[spot > 0] - 1
        before = before[~last[before]]
        changed = np.unique(np.concatenate([before, spot]))
        rank[changed] = _NONE
        open_ = changed[~last[changed]]
        rank[open_], made[open_] = self.pairs(sym[open_], sym[open_ + 1])
        return sym, rank, made, last, changed, kept

    def encode_words(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as byte spans of flat (spaces stand for the space mark): ids, ids per word."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = ends - starts
        raw = flat[common.ragged(size, starts)]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        points = np.where(points == 0x20, 0x2581, points)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        bounds = heads[np.concatenate([[0], np.cumsum(size)])]
        lens = np.diff(bounds)
        sym = self.char_symbol[points]
        done, left = self.merge(sym, lens)
        odd = np.flatnonzero(done >= self.n)
        if not len(odd):
            return done, left
        # a character that is no piece is written as its bytes; it is found by its place in the text
        spans = self._widths(done)
        at = np.cumsum(spans) - spans
        encoded = [chr(p).encode("utf-8", "surrogatepass") for p in points[at[odd]].tolist()]
        count = np.ones(len(done), dtype=np.int64)
        count[odd] = [len(b) for b in encoded]
        out = np.repeat(done, count)
        spots = common.ragged(count[odd], (np.cumsum(count) - count)[odd])
        out[spots] = self.byte_id[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
        word = np.repeat(np.arange(len(left)), left)
        return out, np.bincount(word, weights=count, minlength=len(left)).astype(np.int64)

    def _widths(self, sym: np.ndarray) -> np.ndarray:
        """Characters that each symbol stands for."""
        if not hasattr(self, "_width_of"):
            width = np.ones(self.width, dtype=np.int64)
            for i in range(self.n):
                a, b = self.piece_at[i], self.piece_at[i] + self.piece_len[i]
                width[i] = len(self.piece_bytes[a:b].tobytes().decode("utf-8", "replace"))
            self._width_of = width
        return self._width_of[sym]

    # -- texts ------------------------------------------------------------
    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back with begin and end ids, and how many each text has."""
        docs = [t.replace(_SPACE, " ") if t and _SPACE in t else t or "" for t in texts.to_pylist()]
        rows = [b" " + t.encode() if t else b"" for t in docs]
        flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int64)
        space = flat == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(flat))[: len(starts)]
        by_doc = np.searchsorted(starts, offsets)
        hashes = words.span_hashes(flat, starts, ends)
        while True:
            uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            same = words.equal_spans(flat, starts, ends, flat, starts[first][inverse], ends[first][inverse])
            if same.all():
                break
            # other bytes under the same hash: a hash of their own
            hashes[~same] = words.mix(hashes[~same] + np.uint64(1))
        at, length, pool = self._lookup(uniq, flat, starts[first], ends[first])
        n_word = length[inverse]
        total = np.concatenate([[0], np.cumsum(n_word)])
        per_doc = total[by_doc[1:]] - total[by_doc[:-1]] + 2
        ids = np.empty(int(per_doc.sum()), dtype=np.int32)
        close = np.cumsum(per_doc)
        inner = np.ones(len(ids), dtype=bool)
        inner[close - 1] = inner[close - per_doc] = False
        ids[inner] = pool[common.ragged(n_word, at[inverse])]
        ids[close - per_doc] = self.bos
        ids[close - 1] = self.eos
        return ids, per_doc

    def _lookup(self, uniq, flat, starts, ends):
        """Where each distinct word's ids are in a pool; words not met before are encoded."""
        if self.cache is None or len(self.cache[3]) > CACHE_IDS or len(self.cache[6]) > CACHE_BYTES:
            none = np.zeros(0, np.int64)
            self.cache = (np.zeros(0, np.uint64), none, none, np.zeros(0, np.int32), none, none, np.zeros(0, np.uint8))
        keys, at, length, pool, text_at, text_end, text = self.cache
        spot = np.searchsorted(keys, uniq)
        met = np.flatnonzero(spot < len(keys))
        met = met[keys[spot[met]] == uniq[met]]
        out_at, out_length = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64)
        same = words.equal_spans(flat, starts[met], ends[met], text, text_at[spot[met]], text_end[spot[met]])
        known = met[same]
        out_at[known], out_length[known] = at[spot[known]], length[spot[known]]
        missing = np.ones(len(uniq), dtype=bool)
        missing[known] = False
        new = np.flatnonzero(missing)
        if len(new):
            ids, n = self.encode_words(flat, starts[new], ends[new])
            new_at = len(pool) + np.cumsum(n) - n
            out_at[new], out_length[new] = new_at, n
            pool = np.concatenate([pool, ids.astype(np.int32)])
            # a hash that stands for another word already keeps that one
            missing[met] = False
            keep = np.flatnonzero(missing[new])
            fresh = new[keep]
            size = ends[fresh] - starts[fresh]
            fresh_at = len(text) + np.cumsum(size) - size
            text = np.concatenate([text, flat[common.ragged(size, starts[fresh])]])
            where = spot[fresh]
            keys, at, length = np.insert(keys, where, uniq[fresh]), np.insert(at, where, new_at[keep]), np.insert(length, where, n[keep])
            text_at, text_end = np.insert(text_at, where, fresh_at), np.insert(text_end, where, fresh_at + size)
            self.cache = (keys, at, length, pool, text_at, text_end, text)
        return out_at, out_length, pool

    def decode(self, ids: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all decoded texts and n + 1 offsets: control ids give nothing, the first space goes.

        Bytes that form no character become U+FFFD, one for each.
        """
        size = self.piece_len[ids]
        ends = np.cumsum(size)
        flat = self.piece_bytes[common.ragged(size, self.piece_at[ids])]
        offsets = np.concatenate([[0], np.append(0, ends)[np.cumsum(per_doc)]])
        # the dummy prefix: a space that opens the first piece with any text, unless that is a mark or a byte
        spoken = np.flatnonzero(size > 0)
        doc_ends = np.cumsum(per_doc)
        first = np.searchsorted(spoken, doc_ends - per_doc)
        has = np.flatnonzero((first < np.searchsorted(spoken, doc_ends)))
        opening = spoken[first[has]]
        lead = offsets[:-1][has]
        lead = lead[(flat[lead] == 0x20) & self.plain[ids[opening]]]
        if len(lead):
            keep = np.ones(len(flat), dtype=bool)
            keep[lead] = False
            gone = np.concatenate([[0], np.cumsum(~keep)])
            flat, offsets = flat[keep], offsets - gone[offsets]
        return flat, offsets


def repaired(raw: bytes) -> bytes:
    """raw where each byte that is part of no valid UTF-8 character is U+FFFD."""
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        import codecs

        codecs.register_error("loom-each-byte", lambda e: ("�" * (e.end - e.start), e.end))
        return raw.decode("utf-8", "loom-each-byte").encode()


_TABLES: dict[str, PieceTable] = {}


def loaded(model: bytes) -> PieceTable:
    """The table of a model, built once in each process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _TABLES:
        _TABLES[key] = PieceTable(model)
    return _TABLES[key]


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text with begin and end ids and decode the ids again.

    Columns: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers), decoded_sha256 (of the decoded UTF-8), and with with_ids also
    ids (array<int>) and decoded. Rows keep their order and number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def work(batches):
        piece = loaded(shared.value)
        for part in common.text_slices(batches):
            ids, n = piece.encode(part.column(1))
            flat, offsets = piece.decode(ids, n)
            raw, plain = ids.astype("<u4").tobytes(), flat.tobytes()
            cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
            texts = [repaired(plain[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            columns = {
                "doc_id": part.column(0),
                "n_tokens": pa.array(n.astype(np.int64)),
                "ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts, cuts[1:])]),
                "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                columns["decoded"] = pa.array([t.decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = common.renamed(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.transform(common.batches, work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_decode over documents with the public 32k model."""
    return encode_decode(common.table(spark, sf_dir, "documents"), default_model())


def default_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The bytes of a public tokenizer file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()
