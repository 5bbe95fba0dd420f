import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import nearcopies

WORD, LOW = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    """n_shingles and component of each row by comparing all pairs of rows that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, shared = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for h in holders.values():
        for pair in itertools.combinations(h, 2):
            shared[pair] = shared.get(pair, 0) + 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def family(dice, size, copies, edits):
    base = [f"w{dice.randrange(10**6)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(dice.randint(0, edits)):
            w[dice.randrange(len(w))] = f"e{dice.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_equals_brute_force(spark, documents, k, percent):
    dice = random.Random(k)
    texts = [None, "", " ", "one", "ONE", "one two", "one  two", "a b c d", "a b c d e"]
    for size in (5, 6, 7, 8, 9, 11, 13, 14, 20, 33, 50, 77, 120, 300, 900):
        texts += family(dice, size, 12, max(1, size // 12))
    opening = " ".join(f"open{i}" for i in range(12))
    texts += [opening + " " + " ".join(f"t{dice.randrange(10**6)}" for _ in range(dice.randint(0, 14))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(7, "a b c d"), (3, "one"), (3, "one")]
    dice.shuffle(rows)
    got = nearcopies.group_documents(documents(rows, extra=True), k, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k, percent)


def test_large_groups_in_parts(spark, documents):
    dice = random.Random(9)
    rows = list(enumerate(family(dice, 60, 160, 6) + family(dice, 25, 60, 2)))
    plain = documents(rows)
    classes = nearcopies.set_classes(plain, 4).where("cls is not null").groupBy("cls").agg({"n_shingles": "min", "sketch": "min"}).toDF("cls", "n_shingles", "sketch")
    for group in (16, 1000):
        links = nearcopies.verified_links(plain, classes, 4, 85, group=group)
        roots = {r.node: r.root for r in nearcopies.components(links).collect()}
        named = {}
        for r in nearcopies.set_classes(plain, 4).collect():
            named.setdefault(roots.get(r.cls, r.cls), []).append(r.doc_id)
        want = {}
        for d, _, c in brute(rows, 4, 85):
            want.setdefault(c, []).append(d)
        assert sorted(sorted(v) for v in named.values()) == sorted(sorted(v) for v in want.values())


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        base = rng.integers(1, 1 << 62, 200, dtype=np.uint64)
        a, b = np.unique(base[:150]), np.unique(base[rng.integers(0, 80) :])
        at = np.array([0, len(a), len(a) + len(b)])
        s = nearcopies.bit_sketches(np.concatenate([a, b]), at)
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_wide_sketches_fold():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(1, 1 << 62, 600, dtype=np.uint64))
    wide = nearcopies.bit_sketches(a, np.array([0, len(a)]))[0]
    assert len(wide) == 16
    bit = nearcopies.words.mix(a + np.uint64(5)) & np.uint64(255)
    half = np.bitwise_xor.reduce(wide.reshape(-1, 4), axis=0)
    assert [(int(half[b // 64]) >> (b % 64)) & 1 for b in range(256)] == [int((bit == b).sum() & 1) for b in range(256)]


def test_linked_sets_share_more_blocks_than_are_spare():
    """The pigeonhole: whatever sets are linked, they agree in more than the spare blocks of some band."""
    rng = np.random.default_rng(4)
    rule = nearcopies.Rule(85)
    for n in [7, 8, 12, 13, 17, 25, 40, 90, 200, 700]:
        for _ in range(40):
            a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
            b = a.copy()
            for _ in range(3 * n):  # change until one step further would unlink
                c = np.unique(np.append(b[1:] if rng.random() < 0.5 else b, rng.integers(1, 1 << 63, dtype=np.uint64)))
                rng.shuffle(c)
                if not rule.linked(len(np.intersect1d(a, c)), len(a), len(c)):
                    break
                b = c
            b = np.sort(b)
            row, band, left, key = nearcopies.block_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), rule)
            for order in (1, -1):  # whichever blocks are commonest
                kept = [{(x, y) for x in set(band.tolist()) if ((row == r) & (band == x)).any() for y in np.sort(key[(row == r) & (band == x)])[::order][left[(row == r) & (band == x)][0] :].tolist()} for r in (0, 1)]
                assert kept[0] & kept[1]


def test_a_large_family_costs_as_many_rows_as_members(spark, documents, monkeypatch):
    """Near copies of one text, dealt into parts: each goes to the hub's tasks once, and only the few others further."""
    dice = random.Random(11)
    rows = list(enumerate(family(dice, 120, 3000, 1)))
    met, plain = [], nearcopies._links

    def counting(tasks, percent, roots_of):
        met.append(tasks.count())
        return plain(tasks, percent, roots_of)

    monkeypatch.setattr(nearcopies, "_links", counting)
    monkeypatch.setattr(nearcopies.verified_links, "__defaults__", (nearcopies.SHINGLE, nearcopies.PERCENT, 64))
    got = nearcopies.group_documents(documents(rows), 4, 85).collect()
    assert {r.component_id for r in got} == {0}
    # by sketch a member is in the groups of the few hubs that it shares blocks with, by set in one
    classes = len({t for _, t in rows})
    assert sum(met) < 6 * classes and met[-1] < 1.1 * classes, met


def test_members_that_only_others_lead_to(spark):
    """Chains: each member is like the next one, few are like the hub."""
    base = [np.uint64(10**9 + i) for i in range(400)]
    sets = {i: np.sort(np.array(base[4 * i : 4 * i + 200], dtype=np.uint64)) for i in range(50)}
    rows = [(i, 0, 8 * len(s), bytearray(s.tobytes())) for i, s in sets.items()]
    members = spark.createDataFrame(rows, "cls long, hub long, bytes long, members binary")
    for group in (7, 16, 1000):
        links = nearcopies._group_links(members, ("members",), lambda t: t, 85, nearcopies._by_set, group)
        assert {r.node: r.root for r in nearcopies.components(links).collect()} == {i: 0 for i in range(50)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in nearcopies.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert nearcopies.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, documents):
    a, b = "the same long text again and again here now", "another text that is not at all the same one"
    docs = documents([(5, a), (2, a), (9, b), (9, b), (1, None), (3, ""), (4, a + " x")])
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 9]
    assert nearcopies.keep_one(docs.limit(0)).count() == 0
    for order in (1, -1):  # of differing texts under one id always the same stays
        twice = documents([(7, "b some text"), (7, "a other text"), (8, None)][::order], extra=True)
        kept = nearcopies.keep_one(twice)
        assert kept.columns == twice.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(7, "a other text"), (8, None)]


def test_words_that_look_alike_to_sums(spark, documents):
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    # alike but for one word in the middle
    texts = [" ".join([*(f"w{i}" for i in range(6)), w, *(f"v{i}" for i in range(6))]) for w in (one, other)]
    rows = [(1, texts[0]), (2, texts[1]), (3, one), (4, other)]
    assert {r.doc_id: r.component_id for r in nearcopies.group_documents(documents(rows), 4, 85).collect()} == {i: i for i in range(1, 5)}


def test_long_text(spark, documents):
    text = " ".join(f"w{i}" for i in range(200_000))
    got = nearcopies.group_documents(documents([(1, text), (2, text + " more"), (3, "short")]), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_batches_do_not_change_sets():
    texts = ["A b c d e", None, "", "x", "x y", "a B c D e", "p q r s t u v w"]
    whole = nearcopies.shingle_sets(pa.array(texts), 4)
    for i, t in enumerate(texts):
        one = nearcopies.shingle_sets(pa.array([t], pa.string()), 4)
        assert one[0].tolist() == whole[0][whole[1][i] : whole[1][i + 1]].tolist() and one[2][0] == whole[2][i]
