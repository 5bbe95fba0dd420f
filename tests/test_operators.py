"""Operators on small hand-made vocabularies and parameters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import numbers as num
from tokenloom.functions import text as tx
from tokenloom.operators import checks, parameters, prompts, tokens
from tokenloom.operators import vocabulary as voc
from tokenloom.operators.segment import Lexicon, merged_unknowns, sampled, segment_words, tokenize

TOY = [(0, "<unk>", 0.0, 2), (1, "<tag>", 0.0, 3), (2, "▁", -1.0, 1), (3, "a", -1.0, 1), (4, "b", -2.0, 1), (5, "ab", -3.0, 1)]
ADDED = [(6, "aba", -4.0, 1), (7, "▁aba", -4.0, 1), (8, "Ω", -4.0, 1)]
SCHEMA = "id int, piece string, score double, type int"


@pytest.fixture(scope="module")
def toy(spark):
    base = spark.createDataFrame(TOY, SCHEMA)
    target = spark.createDataFrame(TOY + ADDED, SCHEMA).withColumn("is_active", F.lit(True))
    row_map = spark.createDataFrame([(i, i) for i in range(6)] + [(6, 9)], "source_id int, target_id int")
    return base, target, row_map


def lexicon(rows):
    return Lexicon.from_rows([(p, s, i) for i, p, s, t in rows if t == 1])


@pytest.mark.parametrize(("word", "want"), [("aba", (-4.0, [3, 4, 3])), ("▁aba", (-5.0, [2, 3, 4, 3])), (" a", None), ("ﬁ", None), ("<unk>", None), ("<tag>", None), ("", None)])
def test_literal_paths(word, want):
    assert lexicon(TOY).path(word, strict=True) == want


def test_a_better_score_wins():
    rows = [r if r[1] != "ab" else (5, "ab", -2.0, 1) for r in TOY]
    assert lexicon(rows).path("aba", strict=True) == (-3.0, [5, 3])


def test_best_path_equals_brute_force():
    import itertools
    import random

    dice = random.Random(4)
    pieces = ["a", "b", "ab", "ba", "aab", "bb", "abab"]
    for _ in range(40):
        rows = [(p, float(-dice.randint(1, 6)), i) for i, p in enumerate(pieces, 1)]
        table = {p: (s, i) for p, s, i in rows}
        word = "".join(dice.choice("ab") for _ in range(dice.randint(1, 9)))
        best = None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for k, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[start:k])
                    start = k
            if all(p in table for p in parts):
                found = (-sum(table[p][0] for p in parts), [table[p][1] for p in parts])
                best = min(best, found) if best else found
        got = Lexicon.from_rows(rows).path(word, strict=True)
        assert got == (-best[0], best[1])


def test_unknowns_merge():
    assert merged_unknowns([0, 0, 3, 0, 2, 0, 0]) == [0, 3, 0, 2, 0]
    ids = lexicon(TOY).path("▁axxb")[1]
    assert ids == [2, 3, 0, 0, 4]


@pytest.mark.parametrize("rows", [[("", -1.0, 1)], [("a", math.inf, 1)], [("a", None, 1)], [("a", -1.0, 1), ("a", -2.0, 2)]])
def test_bad_pieces_are_refused(rows):
    with pytest.raises(ValueError):
        Lexicon.from_rows(rows)


def test_inner_boundaries_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        tokenize(docs, {"x": Lexicon.from_rows([("a▁b", -1.0, 1)])})


def test_texts_of_every_kind(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n"), (4, "ab  a"), (4, "ab  a"), (None, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.ids) for r in tokenize(docs, {"x": lexicon(TOY)}).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, []), (4, [2, 3, 4, 2, 3]), (4, [2, 3, 4, 2, 3]), (None, [2, 4])], key=str)
    assert tokenize(docs.limit(0), {"x": lexicon(TOY)}).count() == 0


def test_sampled_paths_spell_the_text(spark):
    docs = spark.createDataFrame([(i, "aba ab abab") for i in range(20)], "doc_id long, text string").withColumn("text", F.concat("text", F.lit(" b"), F.repeat(F.lit("a"), F.col("doc_id").cast("int"))))
    spell = {i: p for i, p, _, _ in TOY}
    drawn = {tuple(r.ids) for r in sampled(docs, lexicon(TOY), 0.5, seed=3).collect()}
    assert len({d[:9] for d in drawn}) > 1
    for ids in drawn:
        assert "".join(spell[i] for i in ids).startswith("▁aba▁ab▁abab▁b")


def test_donors(toy):
    base, target, row_map = toy
    donors = parameters.donor_pieces(base, row_map, target)
    assert sorted(r.id for r in donors.collect()) == [2, 3, 4, 5]
    paths = parameters.donor_paths(parameters.added_ids(target, row_map), donors)
    assert {r.added_id: r.path for r in paths.collect()} == {6: [3, 4, 3], 7: [2, 3, 4, 3], 8: []}
    loads, unit = parameters.donor_loads(paths, donors)
    assert {r.donor_id: float(r.load) / unit for r in loads.collect()} == pytest.approx({2: 1 / 2, 3: 17 / 12, 4: 5 / 6, 5: 1 / 4})
    checks.strict(parameters.load_faults(loads, paths, unit), "loads")
    report = parameters.donor_report(paths, loads, unit, 0.05).first()
    assert (report.added, report.exact, report.fallback) == (3, 2, 1)
    assert report.shift == pytest.approx(math.log(0.05 / (17 / 12)))


def test_donors_without_a_letter(toy):
    base, target, row_map = toy
    donors = parameters.donor_pieces(base, row_map, target.withColumn("is_active", F.col("id") != 3))
    paths = parameters.donor_paths(parameters.added_ids(target, row_map), donors)
    assert all(r.path == [] for r in paths.collect())
    loads, unit = parameters.donor_loads(paths, donors)
    assert {float(r.load) / unit for r in loads.collect()} == {1.0}


def test_means_and_transfer(spark, toy):
    base, target, row_map = toy
    rows = [("embedding", i, [float(4 * i + j) / 13 for j in range(4)]) for i in range(7)]
    params = spark.createDataFrame(rows, "key string, row_id int, vec array<float>")
    donors = parameters.donor_pieces(base, row_map, target)
    paths = parameters.donor_paths(parameters.added_ids(target, row_map), donors)
    means = parameters.donor_means(params, paths, donors)
    got = {r.row_id: r.vec for r in means.collect()}
    assert got[6] == pytest.approx([(40 / 3 + j) / 13 for j in range(4)], rel=1e-6)
    assert got[8] == pytest.approx([(14 + j) / 13 for j in range(4)], rel=1e-6)
    moved = parameters.transfer(params, row_map, means)
    kept = {r.row_id: r.vec for r in moved.collect()}
    assert sorted(kept) == list(range(10))
    assert kept[9] == pytest.approx(rows[6][2]) and kept[2] == pytest.approx(rows[2][2])
    assert parameters.verify_transfer(params, row_map, moved).first().values_changed == 0
    off = moved.withColumn("vec", F.when(F.col("row_id") == 9, F.array(*[F.lit(0.0).cast("float")] * 4)).otherwise(F.col("vec")))
    report = parameters.verify_transfer(params, row_map, off)
    assert report.first().values_changed == 4
    assert parameters.failing_keys(report).first().failing == "embedding"


@pytest.mark.parametrize("ratio", [0, -1, 1, math.nan, math.inf])
def test_bad_ratios(ratio):
    with pytest.raises(ValueError):
        num.mass_shift(ratio, F.lit(1.0))


@pytest.mark.parametrize(
    ("targets", "ok"),
    [((0, 1, 2, 3, 6), True), ((0, 1, 2, 3), False), ((0, 1, 2, 3, None), False), ((0, 1, 2, 3, 4), False), ((0, 1, 1, 3, 6), False), ((0, -1, 2, 3, 6), False), ((0, 7, 2, 3, 6), False), ((0, None, 1, 2, 6), False)],
)
def test_row_maps(spark, targets, ok):
    rows = spark.createDataFrame(list(enumerate(targets)), "source_id int, target_id int")
    assert checks.row_map_faults(rows, 4, 6).isEmpty() == ok


def test_shapes_and_values(spark):
    schema = "key string, row_id int, vec array<float>"
    old = spark.createDataFrame([("e", 0, [1.0, 2.0]), ("e", 1, [1.0, 2.0]), ("s", 0, [1.0])], schema)
    good = spark.createDataFrame([("e", i, [1.0, 2.0]) for i in range(3)] + [("s", 0, [1.0])], schema)
    assert checks.shape_faults(old, good, ("e",)).isEmpty()
    bad = spark.createDataFrame([("e", 0, [1.0]), ("s", 0, [1.0]), ("s", 1, [1.0]), ("x", 0, [1.0])], schema)
    assert {(r.key, r.fault) for r in checks.shape_faults(old, bad, ("e",)).collect()} == {("e", "width"), ("s", "rows"), ("x", "missing")}
    odd = spark.createDataFrame([("e", 0, [1.0, math.nan]), ("e", 1, None), ("e", 2, [math.inf]), ("e", 3, [0.0])], schema)
    assert sorted(r.row_id for r in checks.value_faults(odd).collect()) == [0, 1, 2]


def test_placeholders_and_mask(spark):
    spelt = ["<unk>", tx.PLACEHOLDER % 1, "word", tx.PLACEHOLDER % 3, "last"]
    pieces = spark.createDataFrame(list(enumerate(spelt)), "id int, piece string")
    assert sorted(r.id for r in voc.inactive_by_spelling(pieces).collect()) == [1, 3]
    wrong = spark.createDataFrame([(0, tx.PLACEHOLDER % 1), (1, "text")], "id int, piece string")
    assert voc.inactive_by_spelling(wrong).isEmpty()
    flags = pieces.withColumn("is_active", ~F.col("id").isin(1, 3))
    logits = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, logit double")
    got = {r.id: r.logit for r in parameters.masked(logits, flags).collect()}
    assert got == {0: 0.0, 1: -math.inf, 2: 2.0, 3: -math.inf, 4: 4.0, 5: 5.0}
    assert parameters.masked(logits, flags, enabled=False) is logits


def test_rounding_is_that_of_sql(spark):
    import duckdb

    ties = [(2 * random.Random(i).randrange(5_000_000) + 1) / 2e6 for i in range(2000)]
    near = [math.nextafter(x, to) for x in ties for to in (0.0, math.inf)]
    values = [s * x for x in [*ties, *near, 0.0, 1e-7, 4.9e-7, 5e-7, 1e300, 2.0**53 + 2, math.inf] for s in (1, -1)] + [math.nan, None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = {r.i: r.y for r in rows.select("i", num.rounded(F.col("x"), 6).alias("y")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [[i, x] for i, x in enumerate(values)])
    assert {i: repr(y) for i, y in got.items()} == {i: repr(y) for i, y in con.execute("SELECT i, round(x, 6) FROM t").fetchall()}


def test_logits_are_summed_from_the_left(spark):
    draw = random.Random(5)
    x = [[draw.uniform(-1, 1) for _ in range(64)] for _ in range(300)]
    w = [[draw.uniform(-1, 1) for _ in range(64)] for _ in range(150)]
    inputs, weights = spark.createDataFrame(list(enumerate(x)), "row int, x array<double>"), spark.createDataFrame([(i, v, i / 7) for i, v in enumerate(w)], "id int, w array<double>, b double")

    def logit(row, i):
        total = 0.0
        for p, q in zip(x[row], w[i], strict=True):
            total += p * q
        return total + i / 7

    got = {(r.row, r.id): r.logit for r in parameters.output_logits(inputs, weights).collect()}
    assert got == {(row, i): logit(row, i) for row in range(300) for i in range(150)}
    with pytest.raises(Exception, match="an input of 65 values for weights of 64"):
        parameters.output_logits(spark.createDataFrame([(1, [0.0] * 65)], "row int, x array<double>"), weights).collect()


def test_log_sum_exp(spark):
    rows = spark.createDataFrame([(1, [0.0, 1000.0]), (2, [-math.inf, -math.inf])], "id int, v array<double>")
    got = {r.id: r.x for r in rows.select("id", num.log_sum_exp(F.col("v")).alias("x")).collect()}
    assert got == {1: 1000.0, 2: -math.inf}


def test_ids_and_tokens(spark):
    pieces = spark.createDataFrame(TOY, SCHEMA)
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["ab", "<tag>", "a"])], "k int, tokens array<string>")
    assert {r.k: r.ids for r in tokens.sequence_ids(rows, pieces, "k", skip=("<tag>",)).collect()} == {1: [3, 4], 2: [], 3: [5, 3]}
    with pytest.raises(Exception, match="no such piece: zz"):
        tokens.sequence_ids(spark.createDataFrame([(1, ["zz"])], "k int, tokens array<string>"), pieces, "k").collect()
    ids = spark.createDataFrame([(1, [2, 3, 9, 0, 1, 5])], "k int, ids array<int>")
    valid = tokens.valid_ids(F.col("ids"), 9, F.lit([8]).cast("array<int>"))
    text = tokens.detokenized(valid, tokens.spelling_table(pieces))
    assert ids.select(text.alias("t")).first().t == "a ⁇ ab"
    for bad in ([10], [-1], [8], [None]):
        with pytest.raises(Exception, match="bad ids"):
            spark.createDataFrame([(1, bad)], "k int, ids array<int>").select(valid).collect()


def test_model_changes_are_found(spark):
    base = spark.createDataFrame(TOY, SCHEMA)
    assert checks.model_diff(base, base).isEmpty()
    for column, value, name in (("piece", F.lit("z"), "piece"), ("score", F.col("score") + 0.125, "score"), ("type", F.lit(5), "type")):
        changed = base.withColumn(column, F.when(F.col("id") == 4, value).otherwise(F.col(column)))
        assert [(r.id, r.difference) for r in checks.model_diff(base, changed).collect()] == [(4, name)]
    assert [(r.id, r.difference) for r in checks.model_diff(base, base.where("id < 5")).collect()] == [(5, "missing")]
    with pytest.raises(ValueError, match="models"):
        checks.strict(checks.model_diff(base, base.where("id < 5")), "models")


def test_prompt_registry(spark):
    rows = spark.createDataFrame([("source", "en", 0), ("full", "en", 0), ("full", "hi", 6), ("full", "hi-IN", 6)], "profile string, name string, slot int")
    assert prompts.of_profile(rows, "full", rows.where("profile = 'source'")).count() == 3
    assert prompts.unused_slots(rows.where("profile = 'full'")).count() == 126
    with pytest.raises(ValueError):
        prompts.of_profile(rows, "none")
    with pytest.raises(ValueError):
        prompts.of_profile(rows, "full", rows.where("name = 'hi'"))


def test_normalisation(spark):
    got = spark.range(1).select(tx.normalized(F.lit("Ａﬁ　x‌y！")).alias("t")).first().t
    assert got == "Afi x y!"


def test_segment_words_gives_null_where_nothing_fits(spark):
    words = spark.createDataFrame([("aba",), ("zz",), (None,)], "word string")
    got = {r.word: r.path for r in segment_words(words, lexicon(TOY), strict=True).collect()}
    assert got == {"aba": [3, 4, 3], "zz": None, None: None}


def test_registered_functions(spark):
    from tokenloom.functions.registry import register

    spell = [p for _, p, _, _ in TOY]
    assert register(spark, lexicon(TOY), spell) == register(spark, lexicon(TOY), spell)
    row = spark.sql("SELECT loom_ids(t) AS i, loom_tokens(t) AS k, loom_text(loom_ids(t)) AS x FROM VALUES ('ab  a') AS v(t)").first()
    assert row.i == [2, 3, 4, 2, 3] and row.k == ["▁", "a", "b", "▁", "a"] and row.x == "ab a"
    assert spark.sql("SELECT loom_ids(cast(null AS string)) AS i").first().i == []


def test_network_shapes(spark):
    def rows(**sizes):
        return spark.createDataFrame([(k, i, [1.0] * w) for k, (n, w) in sizes.items() for i in range(n)], "key string, row_id int, vec array<float>")

    faults = lambda df, bias="b", outputs=4: {(r.key, r.fault) for r in checks.network_faults(df, "e", "w", bias, 3, outputs).collect()}
    assert faults(rows(e=(4, 2), w=(4, 3), b=(4, 1))) == set()
    assert faults(rows(e=(4, 2), w=(4, 3)), None) == set()
    assert faults(rows(e=(3, 2), w=(4, 3), b=(4, 2))) == {("e", "rows"), ("b", "width")}
    assert faults(rows(e=(4, 2), w=(5, 3), b=(5, 1)), outputs=5) == {("w", "outputs"), ("b", "outputs")}
    assert faults(rows(e=(4, 2))) == {("w", "missing"), ("b", "missing")}


def plain_path(lexicon, word, strict):
    """The best path by prefixes: the highest sum from the left, then the smallest ids."""
    best = [(0.0, ())] + [None] * len(word)
    for b in range(len(word)):
        for e in range(b + 1, len(word) + 1):
            found = lexicon.pieces.get(word[b:e]) or ((lexicon.unknown, 0) if e == b + 1 and not strict else None)
            if best[b] and found:
                new = (best[b][0] + found[0], (*best[b][1], found[1]))
                if best[e] is None or new[0] > best[e][0] or (new[0] == best[e][0] and new[1] < best[e][1]):
                    best[e] = new
    return best[-1] and (best[-1][0], list(best[-1][1])) if word else None


@pytest.mark.parametrize("tenths", [False, True])
def test_paths_equal_plain_sums_from_the_left(tenths):
    """Whole scores give many ties, scores in tenths sums that differ by the order of adding."""
    dice = random.Random(tenths)
    for _ in range(60):
        letters = "abc"[: dice.randint(1, 3)]
        pieces = sorted({"".join(dice.choice(letters) for _ in range(dice.randint(1, 4))) for _ in range(20)}, key=lambda p: p[::-1])
        lexicon = Lexicon.from_rows([(p, -dice.randint(1, 30) / 10 if tenths else -float(dice.randint(1, 4)), i + 1) for i, p in enumerate(pieces)])
        words = ["".join(dice.choice(letters + "x") for _ in range(dice.randint(0, 14))) for _ in range(40)]
        for strict in (False, True):
            score, n, ids = lexicon.paths(words, strict)
            ends = n.cumsum()
            got = [None if s != s else (float(s), ids[e - k : e].tolist()) for s, k, e in zip(score, n, ends)]
            assert got == [plain_path(lexicon, w, strict) for w in words]


def test_very_long_words():
    lexicon = Lexicon.from_rows([("a", -1003.0, 3), ("aa", -1001.0, 1), ("aaaa", -1002.0, 2)])
    score, ids = lexicon.path("a" * 4001)
    assert len(ids) == 1001 and score == -1002.0 * 1000 - 1003.0 and ids[0] == 2


def test_retokenization_answers_per_row(spark):
    from tokenloom.operators import coverage

    docs = spark.createDataFrame([(1, "ab"), (1, "a"), (None, "ab"), (None, "a"), (2, None)], "doc_id long, text string")
    one = Lexicon.from_rows([("▁", -1.0, 1), ("a", -1.0, 2), ("b", -1.0, 3)])
    two = Lexicon.from_rows([("▁", -1.0, 1), ("a", -1.0, 2), ("ab", -1.0, 3)])
    got = coverage.retokenization(docs, {"one": one, "two": two}, "one", "two").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, True), (1, False), (None, True), (None, False), (2, False)], key=str)


def test_long_words_are_counted_whole(spark):
    word = "".join(chr(97 + i % 23) for i in range(300))
    docs = spark.createDataFrame([(1, f"{word} ab {word}")], "doc_id long, text string")
    counts = voc.word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == {"▁" + word: 2, "▁ab": 1}
    want = {}
    for w, n in (("▁" + word, 2), ("▁ab", 1)):
        for k in range(2, 5):
            for b in range(len(w) - k + 1):
                want[w[b : b + k]] = want.get(w[b : b + k], 0) + n
    assert {r.piece: r.n for r in voc.substring_counts(counts, 2, 4).collect()} == want


def test_states_and_heads(spark):
    kind = "key string, dtype string, shape array<long>, storage string"
    old = spark.createDataFrame([("emb", "f32", [4, 2], "a"), ("out", "f32", [4, 2], "b"), ("enc", "f32", [3, 3], "c"), ("gone", "f32", [1], "d")], kind)
    new = spark.createDataFrame([("emb", "f32", [6, 2], "a"), ("out", "f32", [6, 2], "a"), ("enc", "f16", [3, 3], "c")], kind)
    assert sorted(map(tuple, checks.tensor_faults(old, new, ("emb", "out")).collect())) == [("emb", "shared"), ("enc", "dtype"), ("gone", "missing"), ("out", "shared")]
    wide = spark.createDataFrame([("emb", "f32", [4, 3], "a"), ("out", "f32", [4, 2], "b"), ("enc", "f32", [4, 3], "c"), ("gone", "f32", [1], "d")], kind)
    assert sorted(map(tuple, checks.tensor_faults(old, wide, ("emb", "out")).collect())) == [("emb", "shape"), ("enc", "shape")]
    heads = [("good", "rnnt", True, 0, 1, 9, 10, 10), ("ctc", "ctc", True, 0, 1, 9, 10, 10), ("pad", "rnnt", False, 0, 1, 9, 10, 10), ("tdt", "rnnt", True, 5, 1, 9, 10, 10), ("two", "rnnt", True, 0, 2, 9, 10, 10), ("blank", "rnnt", True, 0, 1, 8, 10, 10), ("more", "rnnt", True, 0, 1, 9, 10, 11)]
    models = spark.createDataFrame(heads, "name string, head string, blank_as_pad boolean, extra_outputs int, embeddings int, padding_id int, outputs int, classes int")
    assert dict(map(tuple, checks.head_faults(models).collect())) == {"ctc": "head", "pad": "padding", "tdt": "extra outputs", "two": "embeddings", "blank": "blank", "more": "classes"}
