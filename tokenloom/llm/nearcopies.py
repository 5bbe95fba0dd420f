"""N-gram Jaccard join by parity sketches (operator 4).

Documents are sets of word shingles. Each element of a set lands in one of B
blocks and flips one bit there, so two sketches differ in at most as many bits,
and in at most as many blocks, as the sets differ in elements. B exceeds the
largest difference that a link allows among documents of a size band by some
spare blocks; linked documents therefore agree in more blocks than are spare,
and blocks (band, number, parity and XOR of the elements' hashes) are joined.
Each document leaves out as many of its commonest blocks as are spare, the
empty ones before anything is shuffled, which loses no link, as it then still
shares a rarer one. Documents that share blocks with the same hub form a group,
in which sizes and the bit distance of their sketches rule out almost every
pair; each set then goes once to the group of all documents that the remaining
pairs lead to, where links are verified. A group of over GROUP documents or
GROUP_BYTES is dealt into parts: all are compared with the hub first, and only
those that are not linked to it with all others, so a family of near copies
costs as many comparisons as it has members. Only a star of links for each
task's components leaves it; the components of all links follow by alternating
star contraction.

Equal sets are one class and are joined once, so copies cost nothing; hashes of
shingles and classes have 64 bits. Null and empty texts have an empty set, link
with nothing and keep their own id. Repeated ids and rows are rows of one
class. An empty table gives an empty result; other columns are ignored; null
ids stay null rows of their class. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm import common, words

SHINGLE = 5
PERCENT = 80
#: Members and bytes of sketches or sets that one task of a group holds, of one side.
GROUP, GROUP_BYTES = 512, 32 << 20
#: Bits of the smallest sketches that candidates are compared by; larger sets have as many bits as members, to a power of two.
SKETCH_BITS = 256
#: Sizes of a band reach from one bound to this multiple of it.
BAND = 1.5
#: Rows up to which class ids are broadcast (16 bytes each).
CLASS_ROWS = 1_000_000


def band_bounds(most: int = 1 << 40) -> np.ndarray:
    """Lower size bounds of the bands."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out, dtype=np.int64)


class Rule:
    """What a similarity of at least percent / 100 means for sizes and differences."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.bounds = band_bounds()

    def most_apart(self, total):
        """The largest symmetric difference of linked sets with this sum of sizes."""
        return (100 - self.percent) * total // (100 + self.percent)

    def linked(self, common_: int, a: int, b: int) -> bool:
        return 100 * common_ >= self.percent * (a + b - common_)

    def bands(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, band, blocks, spare) of the bands that sets take part in: their own and, near its end, the next.

        Linked documents agree in more than `spare` blocks of the larger one's band.
        """
        own = np.searchsorted(self.bounds, size, side="right") - 1
        row = np.arange(len(size))
        near = (size > 0) & (100 * size >= self.percent * self.bounds[own + 1])
        row, band = np.concatenate([row[size > 0], row[near]]), np.concatenate([own[size > 0], own[near] + 1])
        apart = self.most_apart(2 * (self.bounds[band + 1] - 1))
        spare = 2 + apart // 4
        use = apart > 0  # otherwise only equal sets are linked
        return row[use], band[use], (apart + 1 + spare)[use], spare[use]


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch in the order of document and hash, n + 1 offsets, and 64-bit classes."""
    flat, offsets = common.flat_text(texts)
    flat = words.lowered(flat)
    starts, ends, by = words.spans(flat, offsets)
    h = words.span_hashes(flat, starts, ends)
    n = np.diff(by)
    doc = np.repeat(np.arange(len(n)), n)
    full = np.flatnonzero(n[doc] >= k)
    full = full[full + k <= by[doc[full] + 1]]
    value = np.zeros(len(full), dtype=np.uint64)
    for j in range(k):
        value = words.mix(value + h[full + j] + np.uint64(j + 1))
    docs, values = [doc[full]], [value]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = np.zeros(len(few), dtype=np.uint64)
        for j in range(k - 1):
            there = n[few] > j
            at = by[:-1][few[there]] + j
            short[there] = words.mix(short[there] + h[at] + np.uint64(j + 1))
        docs.append(few)
        values.append(words.mix(short + np.uint64(k)))
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    at = np.searchsorted(doc, np.arange(len(n) + 1))
    total = np.zeros(len(n), dtype=np.uint64)
    np.add.at(total, doc, words.mix(value + np.uint64(99)))
    return value, at, words.mix(total + words.mix(np.diff(at).astype(np.uint64)))


def block_keys(value: np.ndarray, at: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, spare, key) of every block of each set."""
    size = np.diff(at)
    row, band, blocks, spare = rule.bands(size)
    first = np.cumsum(blocks) - blocks
    n = size[row]
    element = value[common.ragged(n, at[:-1][row])]
    part = np.repeat(np.arange(len(row)), n)
    block = (((element >> np.uint64(32)) * blocks[part].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + first[part]
    total = int(blocks.sum())
    parity, xor = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.uint64)
    np.bitwise_xor.at(parity, block, np.uint64(1) << (element & np.uint64(63)))
    np.bitwise_xor.at(xor, block, words.mix(element))
    owner = np.repeat(np.arange(len(row)), blocks)
    number = np.arange(total) - first[owner]
    key = words.mix(words.mix(parity) ^ xor ^ words.mix((band[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)))
    # empty blocks are the commonest: as many as are spare stay out
    empty = np.ones(total, dtype=bool)
    empty[block] = False
    before = np.cumsum(empty) - empty
    out = empty & (before - before[first[owner]] < spare[owner]) if total else empty
    left = spare - np.bincount(owner[out], minlength=len(row))
    owner, key = owner[~out], key[~out]
    return row[owner], band[owner], left[owner], key


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketch_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of the sketches of sets of these sizes."""
    bits = np.maximum(SKETCH_BITS, size)
    return (1 << np.ceil(np.log2(bits)).astype(np.int64)) // 64


def bit_sketches(value: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each set the words of a sketch in which every element flips one bit.

    Its halves XORed are the set's sketch of half the width.
    """
    size = np.diff(at)
    width = sketch_words(size)
    out: list[np.ndarray] = [None] * len(size)  # type: ignore[list-item]
    hashed = words.mix(value + np.uint64(5))
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        bits = 64 * w
        for k in range(0, len(of), max(1, (1 << 22) // bits)):
            some = of[k : k + max(1, (1 << 22) // bits)]
            bit = (hashed[common.ragged(size[some], at[:-1][some])] & np.uint64(bits - 1)).astype(np.int64)
            flips = np.bincount(np.repeat(np.arange(len(some)), size[some]) * bits + bit, minlength=len(some) * bits) & 1
            packed = np.packbits(flips.astype(np.uint8).reshape(len(some), bits), axis=1, bitorder="little").view(np.uint64)
            for i, row in zip(some.tolist(), packed):
                out[i] = row
    return out


def set_classes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, class and sketch of every document (null without shingles)."""

    def work(batches):
        for part in common.text_slices(batches, "text"):
            value, at, cls = shingle_sets(part.column("text"), k)
            n = np.diff(at)
            sketch = pa.array([x.tobytes() for x in bit_sketches(value, at)], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_shingles": pa.array(n), "cls": pa.array(cls.view(np.int64), mask=n == 0), "sketch": sketch})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.transform(common.batches, work, f"doc_id {kind}, n_shingles bigint, cls bigint, sketch binary")


class _Seen:
    """Classes that a task has met; of each it passes on the first document only."""

    def __init__(self):
        self.met: set[int] = set()

    def fresh(self, cls: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = []
        for i, (c, n) in enumerate(zip(cls.tolist(), size.tolist())):
            if n and c not in self.met:
                self.met.add(c)
                out.append(i)
        return np.array(out, dtype=np.int64)


def _block_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    def work(batches):
        rule, seen = Rule(percent), _Seen()
        for part in common.text_slices(batches, "text"):
            value, at, cls = shingle_sets(part.column("text"), k)
            pick = seen.fresh(cls, np.diff(at))
            n = np.diff(at)[pick]
            row, band, spare, key = block_keys(value[common.ragged(n, at[:-1][pick])], np.concatenate([[0], np.cumsum(n)]), rule)
            yield pa.RecordBatch.from_arrays([_signed(key), _signed(cls[pick][row]), pa.array((band << 24 | spare).astype(np.int32))], names=["key", "cls", "place"])

    return docs.select("text").transform(common.batches, work, "key bigint, cls bigint, place int")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def work(batches):
        seen = _Seen()
        for part in common.text_slices(batches, "text"):
            value, at, cls = shingle_sets(part.column("text"), k)
            pick = seen.fresh(cls, np.diff(at))
            raw = value.tobytes()
            yield pa.RecordBatch.from_pydict({"cls": _signed(cls[pick]), "members": pa.array([raw[8 * at[i] : 8 * at[i + 1]] for i in pick.tolist()], pa.binary())})

    return docs.select("text").transform(common.batches, work, "cls bigint, members binary")


class _Roots:
    """Union-find over places 0 to n - 1; the smallest place of a set stands for it."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        x, y = self.find(i), self.find(j)
        self.root[max(x, y)] = min(x, y)

    def all(self) -> list[int]:
        return [self.find(i) for i in range(len(self.root))]


def near_pairs(size: np.ndarray, sketches: list[np.ndarray], rule: Rule, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each place the partners whose size and bit distance allow a link; each pair once.

    With side (0 or 1), only pairs of different sides.
    """
    order = np.argsort(size, kind="stable")
    size = size[order]
    sides = None if side is None else side[order]
    width = sketch_words(size)
    # sizes ascend: partners are at most size / similarity
    tops = np.searchsorted(size, size * 100 // rule.percent, side="right")
    for w in np.unique(width).tolist():
        first, last = np.searchsorted(width, w), np.searchsorted(width, w, side="right")
        end = int(tops[last - 1])
        folded = np.stack([np.bitwise_xor.reduce(sketches[i].reshape(-1, w), axis=0) for i in order[first:end].tolist()])
        for a in range(int(first), int(last)):
            other = np.arange(a + 1, int(tops[a]))
            if sides is not None:
                other = other[sides[other] != sides[a]]
            if len(other):
                apart = np.bitwise_count(folded[other - first] ^ folded[a - first]).sum(1, dtype=np.int64)
                other = other[apart <= rule.most_apart(size[a] + size[other])]
                if len(other):
                    yield int(order[a]), order[other]


def possible_roots(size: np.ndarray, sketches: list[np.ndarray], rule: Rule, side: np.ndarray | None = None) -> list[int]:
    """For each place the smallest place that pairs which may be linked connect it to."""
    roots = _Roots(len(size))
    for i, others in near_pairs(size, sketches, rule, side):
        for j in others.tolist():
            roots.join(i, j)
    return roots.all()


def linked_roots(sets: list[np.ndarray], rule: Rule, side: np.ndarray | None = None) -> list[int]:
    """For each set the smallest place that verified links connect it to."""
    size = np.array([len(s) for s in sets])
    roots = _Roots(len(sets))
    if len(sets) > 1:
        at = np.concatenate([[0], np.cumsum(size)])
        for i, others in near_pairs(size, bit_sketches(np.concatenate(sets), at), rule, side):
            for j in others.tolist():
                if roots.find(i) != roots.find(j) and rule.linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                    roots.join(i, j)
    return roots.all()


def _group_links(members: DataFrame, held: tuple[str, ...], with_payload, percent: int, roots_of, group: int) -> DataFrame:
    """Star links (a, b) between members (cls, hub, bytes and the columns `held`) of one hub.

    with_payload: tasks (hub, i, j, side, cls and `held`) to what _links takes.
    """

    def tasks(df: DataFrame, i, j, side) -> DataFrame:
        placed = df.select("hub", F.lit(i).cast("int").alias("i") if isinstance(i, int) else i.alias("i"), F.lit(j).cast("int").alias("j") if isinstance(j, int) else j.alias("j"), F.lit(side).cast("int").alias("side"), "cls", *held)
        return with_payload(placed)

    def parts_of(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy("hub").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
        return sums.select("hub", F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("b") / GROUP_BYTES)).cast("int").alias(name))

    def dealt(df: DataFrame, parts: DataFrame, name: str) -> DataFrame:
        return common.join_checked(df, parts, "hub").withColumn("own", F.pmod(F.xxhash64("cls"), F.col(name)).cast("int"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    large = common.cut_light(parts_of(members, "parts").where("parts > 1"))
    if large.isEmpty():
        return _links(tasks(members, 0, 0, 0), percent, roots_of)
    few = _links(tasks(common.join_checked(members, large, "hub", "left_anti"), 0, 0, 0), percent, roots_of)
    many = dealt(members, large, "parts")
    # every part against the hub, which may have left out the block itself
    hubs = (many.where("cls = hub").dropDuplicates(["hub"]) if held else large.withColumn("cls", F.col("hub"))).withColumn("own", every("parts"))
    others = many.where("cls <> hub")
    stars = common.cut(_links(tasks(hubs, F.col("own"), 0, 0).unionByName(tasks(others, F.col("own"), 0, 1)), percent, roots_of))
    alone = others.join(stars.select(F.col("a").alias("cls"), F.col("b").alias("hub")), ["cls", "hub"], "left_anti").dropDuplicates(["cls", "hub"])
    alone = common.cut(alone.drop("own", "parts"))
    links = few.unionByName(stars)
    if alone.isEmpty():
        return links
    # those that are not linked to the hub against every part
    blocks = common.cut_light(parts_of(alone, "blocks"))
    asked = dealt(common.join_checked(alone, large, "hub"), blocks, "blocks").withColumnRenamed("own", "block").withColumn("own", every("parts"))
    met = common.join_checked(many, blocks, "hub").withColumn("block", every("blocks"))
    return links.unionByName(_links(tasks(asked, F.col("own"), F.col("block"), 0).unionByName(tasks(met, F.col("own"), F.col("block"), 1)), percent, roots_of))


def _links(tasks: DataFrame, percent: int, roots_of) -> DataFrame:
    """Star links (a, b) of every task's components; tasks: hub, i, j, side, cls and payload columns."""

    def groups(batches) -> Iterator[tuple]:
        name, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            # one class may come from several tasks of the step before
            for *key, side, cls, payload in zip(*columns[:5], zip(*columns[5:])):
                if key != name:
                    if held:
                        yield held
                    name, held = key, []
                if not held or held[-1][:2] != (cls, side):
                    held.append((cls, side, payload))
        if held:
            yield held

    def work(batches):
        rule = Rule(percent)
        a, b = [], []
        for held in groups(batches):
            side = np.array([x[1] for x in held], dtype=np.int64)
            for x, r in enumerate(roots_of([x[2] for x in held], rule, side if side.any() else None)):
                if held[r][0] != held[x][0]:
                    a.append(held[x][0])
                    b.append(held[r][0])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = tasks.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "cls", "side")
    return dealt.transform(common.batches, work, "a bigint, b bigint")


def _by_sketch(payloads, rule, side):
    sketches = [np.frombuffer(p[1], dtype=np.uint64) for p in payloads]
    return possible_roots(np.array([p[0] for p in payloads]), sketches, rule, side)


def _by_set(payloads, rule, side):
    return linked_roots([np.frombuffer(p[0], dtype=np.uint64) for p in payloads], rule, side)


def verified_links(docs: DataFrame, classes: DataFrame, k: int = SHINGLE, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """Star links (a, b) between classes whose components are those of all links.

    classes: cls, n_shingles and sketch, in one row for each class.
    """
    by_key = Window.partitionBy("key")
    blocks = _block_rows(docs, k, percent)
    shared = blocks.select("cls", "place", "key", F.min("cls").over(by_key).alias("hub"), F.max("cls").over(by_key).alias("top"), F.count("*").over(by_key).alias("n")).where("hub < top")
    # Linked classes agree in more blocks than are spare, so each may leave out that many of its
    # commonest ones (passages that many texts hold, empty blocks): a rarer one is still shared.
    # The order of blocks is the same for all classes.
    common_first = F.dense_rank().over(Window.partitionBy("cls", "place").orderBy(F.desc("n"), "key"))
    rare = shared.withColumn("place_in", common_first).where(F.col("place_in") > F.col("place").bitwiseAND(0xFFFFFF))
    # a band's bound tells how large the sketches of its sets can be
    bytes_ = F.pow(F.lit(BAND), F.shiftright("place", 24) + 2) / 8 + 32
    members = common.cut(rare.groupBy("cls", "hub").agg(F.max(bytes_).alias("bytes")))
    # classes of one hub share blocks; sizes and sketches leave the pairs that may be linked
    possible = components(_group_links(members, (), lambda t: t.join(classes, "cls").select("hub", "i", "j", "side", "cls", "n_shingles", "sketch"), percent, _by_sketch, group))
    # each set goes once to the group of all that possible links lead to
    placed = common.cut(possible.select(F.col("node").alias("cls"), F.col("root").alias("hub")))
    sets = common.cut(common.join_checked(_sets(docs, k), placed, "cls", "inner", CLASS_ROWS).select("cls", "hub", F.length("members").alias("bytes"), "members"))
    return _group_links(sets, ("members",), lambda t: t, percent, _by_set, group)


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node that links lead to, for every node with a link.

    Large and small stars in turn until nothing changes; each round is written
    to the shared folder.
    """
    edges = common.cut_light(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = common.cut_light(small.where("u <> v").distinct())
        before, now = now, mark(edges)
        if before == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def group_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links lead to) of every row."""
    plain = common.renamed(docs, doc_id=id_col, text=text_col)
    rows = common.cut(set_classes(plain, k))
    sketches = rows.where("cls is not null").groupBy("cls").agg(F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    roots = components(verified_links(plain, sketches, k, percent))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    placed = classes.join(roots, classes.cls == roots.node, "left").where("n > 1 or root is not null").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    placed = common.cut(placed)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component"))
    named = common.cut(placed.join(smallest, "root").select("cls", "component"))
    joined = common.join_checked(rows, named, "cls", "left", CLASS_ROWS)
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that are linked to one of a smaller id; of rows with one id one stays."""
    found = common.cut(group_documents(docs, k, percent))
    gone = common.cut_light(found.where("doc_id <> component_id").select("doc_id").distinct())
    twice = common.cut_light(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    left = common.join_checked(docs, gone, "doc_id", "left_anti", CLASS_ROWS)
    single = common.join_checked(left, twice, "doc_id", "left_anti", CLASS_ROWS)
    # of rows with one id that of the smallest text, and then of the smallest other columns
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    double = common.join_checked(left, twice, "doc_id", "left_semi", CLASS_ROWS).groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("__row"))
    return single.unionByName(double.select("__row.*"))


def op4_nearcopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles are similar by 0.85 or more."""
    return group_documents(common.table(spark, sf_dir, "documents"), k=4, percent=85)


#: All pairs that share a shingle are counted, links followed to their ends.
ORACLE_SQL = r"""
WITH RECURSIVE split AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM split WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM sets GROUP BY r),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2) p
  JOIN sizes m ON m.r = a JOIN sizes n ON n.r = b WHERE 100 * k >= 85 * (m.n + n.n - k)),
reach(a, b) AS (SELECT r, r FROM split UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM split d JOIN reach ON reach.a = d.r JOIN split e ON e.r = reach.b LEFT JOIN sizes z ON z.r = d.r GROUP BY d.r, d.doc_id
"""
