"""Secret scans with a random forest against false positives (operator 1, DataFrame and SQL functions only).

Candidates are runs of 16 or more token characters with a digit, which end
before a slash that a known key form follows, and what a keyword assigns: runs
of eight or more characters behind `password=`, `token: "` and the like, with or
without a digit. One pass of `split` and `regexp_extract_all` gives them with
the text on both sides; each is described by its length, its character
transitions, the share of it that dictionary words cover, the path of its
document and the neighbouring words (in the NEAR characters on either side). A
forest fitted on labelled findings tells secrets from hashes, numbers, slugs
and placeholders. Its trees are written out as one SQL expression that is
evaluated inside the projection of the document, so scanning neither explodes
nor shuffles anything, whatever a document or a source holds.

Null and empty texts have no candidate. Null paths are empty. Repeated rows and
ids are scanned each for itself, equal candidates of a document are findings
each. An empty table gives an empty result; other columns pass through. Texts
of any length are scanned whole. Labelled findings with a null label are left
out; without both classes the forest is one leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

#: Beginnings of keys that are known by their form.
_FORMS = r"AKIA|ASIA|AGPA|gh[po]_|sk_live_|sk-|xox[bp]-|AIza|glpat-|npm_"
_ASSIGNED = r"(?<=[:=\"'\s])(?<=(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd]|[Pp][Hh][Rr][Aa][Ss][Ee])|[Pp][Ww][Dd]|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Kk][Ee][Yy])[\"']?\s?[:=]\s?[\"']?)[A-Za-z0-9+/_.!@#$%^&*~-]{8,}+"
_RUN = rf"(?:(?<![A-Za-z0-9+/_-])|(?<=/)(?={_FORMS}))(?=[A-Za-z0-9+/_-]{{16}})(?=[A-Za-z+/_-]*+[0-9])(?:[A-Za-z0-9+_-]++|/(?!{_FORMS}))++"
CANDIDATE = rf"(?:{_ASSIGNED}|{_RUN})={{0,2}}"
#: Characters on either side that neighbouring words are looked for in.
NEAR = 64
#: Candidates whose lengths are added up in one go.
STRIDE = 256
MASK = "[SECRET]"
SECRET = 0.5
#: Rows of the default labelled findings, a documented bound.
TRAIN_ROWS = 6_000
TREES, DEPTH = 24, 6
#: Words that slugs, file names and placeholders are made of.
DICTIONARY = "the and for test example sample dummy demo image photo thumb small large icon file page item user admin name data text html json config default version build release update order invoice number index main final draft copy backup report summary chapter section article session token secret password placeholder changeme your here insert value key foo bar baz lorem ipsum january february march april june july august monday friday sunday north south east west red green blue black white".split()
_KEYWORD = r"(pass(word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth[a-z]*|credentials?|bearer|private[_-]?key|client[_-]?secret)"
_BENIGN = r"(commit|rev(ision)?|sha-?[0-9]*|md5|checksum|digest|uuid|guid|etag|order|invoice|card|isbn|phone|build|version|hash|tracking|serial)"
_KNOWN = rf"^/?({_FORMS})"

#: Features by name, over the strings c (candidate), b (text before), a (text after) and p (path).
FEATURES = {
    "length": "length(c)",
    "transitions": "regexp_count(c, '(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]') / length(c)",
    "letter_pairs": "regexp_count(lower(c), '(?=(th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce))') / length(c)",
    "digits": "regexp_count(c, '[0-9]') / length(c)",
    "capitals": "regexp_count(c, '[A-Z]') / length(c)",
    "marks": "regexp_count(c, '[^A-Za-z0-9]') / length(c)",
    "vowels": "regexp_count(lower(c), '[aeiou]') / length(c)",
    "distinct": "size(array_distinct(split(c, ''))) / length(c)",
    "hex": "if(c rlike '^[0-9a-f]+$', 1, 0)",
    "decimal": "if(c rlike '^[0-9+/_-]+$', 1, 0)",
    "grouped": "if(c rlike '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$', 1, 0)",
    "run": "if(c rlike '(.)\\\\1{4}', 1, 0)",
    "known": f"if(c rlike '{_KNOWN}', 1, 0)",
    "dictionary": f"1 - length(regexp_replace(lower(c), '{'|'.join(DICTIONARY)}', '')) / length(c)",
    "path_trial": "if(lower(p) rlike '(^|[^a-z])(tests?|examples?|samples?|docs?|fixtures?|mocks?|lock)([^a-z]|$)', 1, 0)",
    "path_settings": "if(lower(p) rlike '(env|config|settings|credential|secret|[.]ya?ml|[.]ini)', 1, 0)",
    "keyword_before": f"if(lower(b) rlike '{_KEYWORD}[^a-z0-9]{{1,6}}$', 1, 0)",
    "benign_before": f"if(lower(b) rlike '{_BENIGN}[^a-z0-9]{{1,6}}$', 1, 0)",
    "assigned": "if(b rlike '[:=]>?\\\\s*[\"'']?$', 1, 0)",
    "quoted": "if(b rlike '[\"'']$' and a rlike '^[\"'']', 1, 0)",
    "in_path": "if(b rlike '[./\\\\\\\\:]$' or a rlike '^([.][a-z]|/)', 1, 0)",
    "trial_near": "if(lower(concat(b, ' ', a)) rlike '(example|sample|dummy|placeholder|your[_-]|changeme|redacted|fake)', 1, 0)",
}


def _features(c: str, b: str, a: str, p: str) -> str:
    """An array of all features over four SQL expressions."""
    import re

    names = {"c": c, "b": b, "a": a, "p": p}
    outside = r"('(?:[^'\\]|\\.|'')*')|(?<![\w.])([cbap])(?![\w(])"
    return "array(" + ", ".join("cast(" + re.sub(outside, lambda m: m[1] or f"({names[m[2]]})", sql) + " as double)" for sql in FEATURES.values()) + ")"


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """Labelled findings made from rules: candidate, before, after, path, label.

    Secrets are random keys in usual forms and places; the others are hashes,
    numbers, identifiers, slugs, paths and placeholders in theirs.
    """
    word = "element_at(array({}), 1 + cast(pmod(hash(id, {}), {}) as int))"

    def pick(values: list[str], salt: int) -> str:
        return word.format(", ".join("'" + v.replace("'", "''").replace("\\", "\\\\") + "'" for v in values), salt, len(values))

    hexes = "concat(sha1(concat('x', id)), sha1(concat('y', id)))"
    b64 = "translate(base64(unhex(sha2(concat('z', id), 512))), '\\n\\r=', '')"
    capital = f"upper(translate({b64}, '+/0189', 'QZRTVX'))"
    digits = "translate(sha2(concat('d', id), 256), 'abcdef', '204861')"
    prose = ["on the of and", "that is ti in", "für die und", "de la que el", "les des par un", "see the page", ""]
    lead = [f"{w}{s}" for w in ("password", "passwd", "token", "secret", "api_key", "apikey", "access_key", "auth", "client_secret") for s in ("=", ": ", " = \"", "=\"", ": '", " = ")]
    benign = [f"{w}{s}" for w in ("commit", "sha1", "md5", "checksum", "etag", "order", "invoice", "card", "build", "tracking", "uuid") for s in (" ", ": ", "=", " = \"")]
    slug = f"concat({pick(DICTIONARY, 31)}, {{0}}, {pick(DICTIONARY, 32)}, {{0}}, {pick(DICTIONARY, 33)}, {{0}}, cast(pmod(hash(id, 34), 9999) as string))".format
    size = "(16 + cast(pmod(hash(id, 5), 33) as int))"
    kinds = [
        # secrets: candidate, before
        (f"left({hexes}, {size})", pick(lead, 11), 1),
        (f"left({b64}, {size})", pick(lead, 12), 1),
        (f"concat({pick(['AKIA', 'ASIA'], 13)}, left({capital}, 16))", f"if(id % 3 = 0, {pick(lead, 14)}, concat({pick(prose, 15)}, ' '))", 1),
        (f"left(translate({b64}, '+/0123456789', 'kqGhWmRtYzXb'), 8 + cast(pmod(hash(id, 41), 17) as int))", pick(lead, 42), 1),
        (f"concat(left({b64}, 5), {pick(['!', '.', '#', '_', '-'], 43)}, right({b64}, 3 + cast(pmod(hash(id, 44), 6) as int)))", pick(lead, 45), 1),
        (f"concat({pick(['ghp_', 'sk_live_', 'xoxb-', 'glpat-', 'AIza'], 16)}, left({b64}, 36))", f"if(id % 3 = 0, {pick(lead, 17)}, concat({pick(prose, 18)}, ' '))", 1),
        # no secrets
        (f"left({digits}, {pick(['16', '16', '18', '20'], 19)})", f"concat({pick(prose, 20)}, ' ')", 0),
        (f"left({hexes}, {pick(['32', '40', '64'], 21)})", f"if(id % 2 = 0, {pick(benign, 22)}, concat({pick(prose, 23)}, ' '))", 0),
        ("concat(left(md5(string(id)), 8), '-', substr(md5(string(id)), 9, 4), '-', substr(md5(string(id)), 13, 4), '-', substr(md5(string(id)), 17, 4), '-', right(md5(string(id)), 12))", f"if(id % 2 = 0, {pick(benign, 24)}, concat({pick(prose, 25)}, ' '))", 0),
        (slug("'-'"), f"if(id % 2 = 0, {pick(['/', 'href=\"/', 'src=\"', 'https://example.org/'], 26)}, concat({pick(prose, 27)}, ' '))", 0),
        (slug("'_'"), f"if(id % 4 = 0, {pick(lead, 28)}, concat({pick(prose, 29)}, ' '))", 0),
        (f"concat({pick(['your-api-key-here-', 'xxxxxxxxxxxxxxxx', 'changeme-changeme-', 'example-token-example-', '0000000000000000', 'placeholder-value-'], 30)}, cast(pmod(hash(id, 36), 99) as string))", pick(lead, 35), 0),
        (f"left({digits}, 16)", pick(benign, 37), 0),
        (f"concat({pick(DICTIONARY, 46)}, {pick(['', '', '.', '_', '-'], 47)}, {pick(DICTIONARY, 48)})", pick(lead, 49), 0),
        (f"concat({pick(['reading', 'writing', 'management', 'rotation', 'generator', 'required', 'unbekannt', 'nouvelle', 'siguiente'], 50)}, {pick(['', '', '.', '-'], 51)}, {pick(['', '', 'policy', 'storage', 'handler'], 52)})", pick(lead, 53), 0),
    ]
    case = lambda k: "case " + " ".join(f"when kind = {i} then {x[k]}" for i, x in enumerate(kinds)) + " end"
    base = spark.range(rows, numPartitions=2).selectExpr("id", f"cast(pmod(hash(id, 1), {len(kinds)}) as int) as kind")
    found = base.selectExpr("id", f"{case(0)} as candidate", f"concat({pick(prose, 2)}, ' ', {case(1)}) as before", f"cast({case(2)} as double) as label")
    after = "case when before rlike '\"$' then '\" on it' when before rlike '''$' then ''' and' when pmod(hash(id, 3), 8) = 0 then ', of' else ' the of' end"
    return found.selectExpr("candidate", "before", f"{after} as after", f"{pick(['', '', '', '', 'src0', 'src7', 'src12', 'web', 'app/config.yml', 'deploy/.env', 'src/main.py', 'tests/data.py', 'docs/readme.md'], 4)} as path", "label")


def _tree_sql(node, array: str) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        bad, good = (list(node.impurityStats().stats()) + [0.0])[:2]
        return f"{float(good / max(bad + good, 1e-9))!r}D"
    split = node.split()
    return f"if({array}[{split.featureIndex()}] <= {split.threshold()!r}D, {_tree_sql(node.leftChild(), array)}, {_tree_sql(node.rightChild(), array)})"


def fit_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 17):
    """A forest on labelled findings (candidate, before, after, path, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = findings.where("label is not null and candidate is not null and length(candidate) > 0")
    rows = rows.select(F.expr(_features("candidate", "coalesce(before, '')", "coalesce(after, '')", "coalesce(path, '')")).alias("f"), F.col("label").cast("double").alias("label"))
    rows = rows.select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8, minInstancesPerNode=3).fit(rows)


def forest_sql(model, array: str = "f") -> str:
    """The forest's mean share of secrets as SQL over an array of features."""
    parts = [f"({_tree_sql(t._java_obj.rootNode(), array)})" for t in model.trees]
    return f"(({' + '.join(parts)}) / {len(parts)}D)"


def scan(docs: DataFrame, model, text_col: str = "text", path_col: str | None = "source", least: float = SECRET) -> DataFrame:
    """The rows of docs with a column `findings`: structs of candidate, begin, end (characters) and score, in order.

    A second column, `redacted`, is the text with findings of at least `least` masked. They are the last two
    columns, with underscores behind their names where docs has such columns in any case.
    """
    taken = list(docs.columns)
    found, clean = "findings", "redacted"
    while {found, clean} & {c.lower() for c in taken}:
        found, clean = found + "_", clean + "_"
    c_, p_, n_, f_ = (common.free_name([*taken, found, clean], name) for name in ("__c", "__p", "__n", "__f"))
    text = f"coalesce(`{text_col}`, '')"
    path = f"coalesce(cast(`{path_col}` as string), '')" if path_col in taken else "''"
    pattern = CANDIDATE.replace("\\", "\\\\").replace("'", "\\'")
    score = forest_sql(model, "x.f")
    some = f"{text} rlike '{pattern}'"
    steps = docs.withColumn(c_, F.expr(f"if({some}, regexp_extract_all({text}, '{pattern}', 0), array())")).withColumn(p_, F.expr(f"if({some}, split({text}, '{pattern}'), array({text}))"))
    # where candidates end: lengths of all pieces and candidates, added up by strides and then within each
    steps = steps.withColumn(n_, F.expr(f"transform({c_}, (c, i) -> length({p_}[i]) + length(c))"))
    strides = f"transform(sequence(0, size({n_}) div {STRIDE}), j -> aggregate(slice({n_}, j * {STRIDE} + 1, {STRIDE}), 0, (s, x) -> s + x))"
    before = f"aggregate({strides}, array(0), (s, x) -> concat(s, array(element_at(s, -1) + x)))"
    # the sums before strides are a variable (b), so that they are not computed anew for each candidate
    ends = f"transform({n_}, (x, i) -> b[i div {STRIDE}] + aggregate(slice({n_}, i - i % {STRIDE} + 1, i % {STRIDE} + 1), 0, (s, y) -> s + y))"
    steps = steps.withColumn(n_, F.expr(f"element_at(transform(array({before}), b -> {ends}), 1)"))
    described = _features("c", f"right({p_}[i], {NEAR})", f"left({p_}[i + 1], {NEAR})", path)
    steps = steps.withColumn(f_, F.expr(f"transform({c_}, (c, i) -> struct(c as candidate, {n_}[i] - length(c) as begin, {n_}[i] as `end`, {described} as f))"))
    steps = steps.withColumn(found, F.expr(f"transform({f_}, x -> struct(x.candidate as candidate, x.begin as begin, x.`end` as `end`, {score} as score))"))
    masked = f"if({found}[i].score >= {least}, '{MASK}', {c_}[i])"
    steps = steps.withColumn(clean, F.expr(f"if(`{text_col}` is null, null, array_join(transform({p_}, (t, i) -> if(i < size({c_}), concat(t, {masked}), t)), ''))"))
    return steps.select(*(f"`{c}`" for c in taken), found, clean)


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", path_col: str | None = "source", findings: DataFrame | None = None) -> DataFrame:
    """docs with secrets masked, and their lengths renewed."""
    model = fit_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    done = scan(docs, model, text_col, path_col)
    clean: Column = F.col(done.columns[-1])
    new = {text_col: clean}
    if size_col in docs.columns:
        new[size_col] = F.length(clean).cast(docs.schema[size_col].dataType)
    return done.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of candidates and secrets, and the secrets' spans, for every document."""
    docs = common.renamed(common.table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", source="source")
    done = scan(docs, fit_forest(labelled_findings(spark)))
    secrets = F.filter("findings", lambda x: x.score >= SECRET)
    spans = F.transform(secrets, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))
    return done.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), spans.alias("spans"), F.sha2("redacted", 256).alias("redacted_sha256"))
