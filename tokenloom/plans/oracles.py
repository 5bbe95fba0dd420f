"""DuckDB SQL that computes what the catalog's queries compute, from the same tables."""

from __future__ import annotations

from tokenloom.functions import text as tx
from tokenloom.operators import vocabulary as voc

_SPLIT = "[ \\t\\n\\r▁]+"
_PLACEHOLDER = tx.PLACEHOLDER.replace("%d", "' || id || '")

_WORDS = f"""
words AS MATERIALIZED (
  SELECT '▁' || x AS word, count(*) AS n
  FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '{_SPLIT}')) AS x FROM documents)
  WHERE x <> '' GROUP BY x)"""


def _substrings(low: int, high: int) -> str:
    return f"""SELECT substr(word, b, l) AS piece, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT word, n, l, unnest(generate_series(1, length(word) - l + 1)) AS b FROM words, range({low}, {high + 1}) t(l) WHERE length(word) >= l)
  GROUP BY 1"""


_BASE = f"""{_WORDS},
base AS MATERIALIZED (
  SELECT 0 AS id, '<unk>' AS piece, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS score, 2 AS type
  UNION ALL
  SELECT CAST(k AS INTEGER), piece, n, CAST(-(1000 + k) AS DOUBLE), 1
  FROM (SELECT piece, n, row_number() OVER (ORDER BY n DESC, piece) AS k FROM ({_substrings(1, 4)})) WHERE k <= {voc.BASE_PIECES})"""

_PROFILES = f"""{_BASE},
added AS MATERIALIZED (
  SELECT CAST(k - 1 AS INTEGER) AS ord, piece, n, CAST(-(5000 + k - 1) AS DOUBLE) AS score
  FROM (SELECT piece, n, row_number() OVER (ORDER BY n DESC, piece) AS k FROM ({_substrings(5, 6)})) WHERE k <= {voc.ADDED_PIECES}),
base_size AS (SELECT count(*) AS s FROM base),
whole AS (
  SELECT id, piece, score, type FROM base
  UNION ALL SELECT CAST(s + ord AS INTEGER), piece, score, 1 FROM added, base_size),
slots AS (
  SELECT p.profile, w.*, CAST(CASE WHEN p.extended THEN (SELECT count(*) FROM whole) ELSE s END AS INTEGER) AS blank_id,
         NOT (p.limited AND w.id < s AND w.type = 1 AND NOT regexp_full_match(w.piece, '[▁!-~]+')) AS is_active
  FROM whole w, base_size, (VALUES ('original', false, false), ('latin', false, true), ('latin-indic', true, true), ('full', true, false)) p(profile, extended, limited)
  WHERE p.extended OR w.id < s),
pieces AS MATERIALIZED (
  SELECT profile, id, CASE WHEN is_active THEN piece ELSE '{_PLACEHOLDER}' END AS piece, CASE WHEN is_active THEN score ELSE 0 END AS score,
         CASE WHEN is_active THEN type ELSE 5 END AS type, is_active, blank_id
  FROM slots)"""


def _paths(name: str, words: str, pieces: str, unknown: bool, most: int = 1) -> str:
    """CTEs that end in {name}(word, score, path): each word's best path over normal pieces (id, piece, score).

    Each round adds one piece to every kept path; of the paths of one word and round that end at one
    place the best stays, and in the end the best of all rounds.
    """
    spare = f"""
  UNION ALL
  SELECT word, b, b + 1, 0, (SELECT min(score) FROM {name}_p) - 10000
  FROM (SELECT word, unnest(generate_series(1, length(word))) AS b FROM {name}_w)
  WHERE substr(word, b, 1) NOT IN (SELECT piece FROM {name}_p WHERE length(piece) = 1)""" if unknown else ""
    return f"""
{name}_w AS MATERIALIZED ({words}),
{name}_p AS MATERIALIZED ({pieces}),
{name}_e AS MATERIALIZED (
  SELECT word, b, b + l AS e, id, score
  FROM (SELECT word, l, unnest(generate_series(1, length(word) - l + 1)) AS b FROM {name}_w, range(1, (SELECT max(length(piece)) + 1 FROM {name}_p)) t(l) WHERE length(word) >= l) s
  JOIN {name}_p p ON p.piece = substr(s.word, s.b, s.l){spare}),
{name}_r(word, pos, score, path) AS (
  SELECT word, CAST(1 AS BIGINT), CAST(0 AS DOUBLE), CAST([] AS INTEGER[]) FROM {name}_w
  UNION ALL
  SELECT word, e, score, path FROM (
    SELECT r.word, x.e, r.score + x.score AS score, list_append(r.path, x.id) AS path,
           row_number() OVER (PARTITION BY r.word, x.e ORDER BY r.score + x.score DESC, list_append(r.path, x.id)) AS k
    FROM {name}_r r JOIN {name}_e x ON x.word = r.word AND x.b = r.pos) WHERE k <= {most}),
{name} AS MATERIALIZED (
  SELECT word, score, path, k FROM (
    SELECT word, score, path, row_number() OVER (PARTITION BY word ORDER BY score DESC, path) AS k
    FROM {name}_r WHERE pos = length(word) + 1) WHERE k <= {most})"""


_NORMAL = "SELECT id, piece, score FROM pieces WHERE type = 1 AND profile = '{}'"
_ALL_WORDS = """
parts AS MATERIALIZED (
  SELECT row, doc_id, lang, pos, '▁' || x AS word
  FROM (SELECT row_number() OVER () AS row, doc_id, lang, unnest(s) AS x, generate_subscripts(s, 1) AS pos
        FROM (SELECT *, string_split_regex(coalesce(text, ''), '{split}') AS s FROM documents)) WHERE x <> ''),
docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, lang, text FROM documents)""".format(split=_SPLIT)


def _tokens(name: str) -> str:
    """CTE {name}_t(row, ids): the ids of every document under the paths {name}, with each run of unknowns as one."""
    return f"""
{name}_t AS MATERIALIZED (
  SELECT d.row, any_value(d.doc_id) AS doc_id, any_value(d.lang) AS lang, coalesce(flatten(list(p.path ORDER BY pos) FILTER (p.path IS NOT NULL)), []) AS raw
  FROM docs d LEFT JOIN parts USING (row) LEFT JOIN {name} p USING (word) GROUP BY d.row),
{name}_i AS MATERIALIZED (
  SELECT row, doc_id, lang, list_filter(raw, lambda x, i: x <> 0 OR i = 1 OR raw[i - 1] <> 0) AS ids FROM {name}_t)"""


def _two_profiles() -> str:
    words = "SELECT DISTINCT word FROM parts"
    return f"WITH RECURSIVE {_PROFILES},{_ALL_WORDS},{_paths('one', words, _NORMAL.format('original'), True)},{_tokens('one')},{_paths('two', words, _NORMAL.format('latin'), True)},{_tokens('two')}"


_ROW_MAP = """
row_maps AS (
  SELECT b.profile, CAST(source_id AS INTEGER) AS source_id, CAST(CASE WHEN source_id = s THEN blank_id ELSE source_id END AS INTEGER) AS target_id
  FROM (SELECT profile, max(blank_id) AS blank_id, (SELECT s FROM base_size) AS s, unnest(generate_series(0, (SELECT s FROM base_size))) AS source_id FROM pieces GROUP BY profile) b)"""

_DONORS = f"""{_PROFILES},{_ROW_MAP},
donors AS MATERIALIZED (
  SELECT p.id, b.piece, b.score FROM base b JOIN pieces p ON p.profile = 'latin-indic' AND p.id = b.id AND p.is_active WHERE b.type = 1),
new AS MATERIALIZED (
  SELECT id, piece FROM pieces WHERE profile = 'latin-indic' AND id NOT IN (SELECT target_id FROM row_maps WHERE profile = 'latin-indic')),
{_paths('dp', 'SELECT DISTINCT piece AS word FROM new', 'SELECT id, piece, score FROM donors', False)},
paths AS MATERIALIZED (SELECT n.id AS added_id, coalesce(d.path, []) AS path FROM new n LEFT JOIN dp d ON d.word = n.piece)"""

# a unit that divides by every path length and by the number of donors
_LOADS = """
facts AS (SELECT coalesce(max(len(path)), 0) AS longest, count(*) FILTER (len(path) = 0) AS fallbacks, count(*) AS added, (SELECT count(*) FROM donors) AS n FROM paths),
lcms(k, v) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT k + 1, lcm(v, k + 1) FROM lcms, facts WHERE k < longest),
units AS (SELECT max(v) * greatest(1, (SELECT n FROM facts)) AS unit FROM lcms),
loads AS MATERIALIZED (
  SELECT d.id AS donor_id, CAST(coalesce(sum(s.share), 0) AS HUGEINT) + any_value((SELECT unit // n * fallbacks FROM facts, units)) AS load
  FROM donors d LEFT JOIN (SELECT unnest(path) AS id, (SELECT unit FROM units) // len(path) AS share FROM paths) s USING (id) GROUP BY d.id)"""

_LOGITS = """
logits AS MATERIALIZED (
  SELECT CAST(vec_id AS INTEGER) AS row, CAST(o AS INTEGER) AS id,
         list_sum(list_transform(embedding, lambda x, d: CAST(x AS DOUBLE) * ((o * 7 + (d - 1) * 3) % 11 - 5) / 8)) + o / 100 AS logit
  FROM embeddings, range(40) t(o))"""

_STEPS = """
steps AS (
  SELECT CAST(i + 1000000 AS INTEGER) AS added_id, CASE WHEN i % 8 = 0 THEN CAST([] AS BIGINT[]) ELSE [i % 7, i % 5 * 2, i % 7] END AS path FROM range(64) t(i)),
cells AS MATERIALIZED (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"""


def _values(rows) -> str:
    def one(x):
        return "NULL" if x is None else "'" + x + "'" if isinstance(x, str) else "[" + ", ".join(map(one, x)) + "]::INTEGER[]" if isinstance(x, list) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def all_sql(prompts: list[tuple], sequences: list[tuple]) -> dict[str, str]:
    """SQL by query name."""
    registry = f"(VALUES {_values(prompts)}) t(profile, name, slot)"
    return {
        "vocab_topk": f"WITH {_BASE} SELECT id, piece, n, score, type FROM base",
        "profile_active_vocab": f"WITH {_PROFILES} SELECT profile, piece, id FROM pieces WHERE is_active",
        "profile_acoustic_vocab": f"WITH {_PROFILES} SELECT profile, piece, id FROM pieces",
        "profile_summary": f"WITH {_PROFILES} SELECT profile, count(*) AS text_entries, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive, count(*) FILTER (id >= (SELECT s FROM base_size)) AS added, max(blank_id) AS blank_id FROM pieces GROUP BY profile",
        "placeholder_slots": f"WITH {_PROFILES} SELECT profile, id, piece, CAST(score AS DOUBLE) AS score, type FROM pieces WHERE NOT is_active",
        "append_additions": f"WITH {_PROFILES} SELECT id, piece, score, type FROM whole WHERE id >= (SELECT s FROM base_size)",
        "row_map": f"WITH {_PROFILES},{_ROW_MAP} SELECT profile, source_id, target_id FROM row_maps",
        "inactive_anti_join": f"WITH {_PROFILES} SELECT profile, id FROM pieces WHERE NOT is_active",
        "distinct_spellings": f"WITH {_PROFILES} SELECT DISTINCT piece FROM pieces WHERE is_active",
        "symbol_restriction": f"WITH {_PROFILES} SELECT p.profile, p.piece FROM pieces p JOIN base b ON b.piece = p.piece WHERE b.id % 10 = 1 AND p.is_active",
        "segment_words": f"WITH RECURSIVE {_BASE},{_paths('dp', 'SELECT word FROM words', 'SELECT id, piece, score FROM base WHERE type = 1', False)} SELECT word, score, array_to_string(path, ',') AS path FROM dp",
        "tokenize_documents": f"WITH RECURSIVE {_PROFILES},{_ALL_WORDS},{_paths('one', 'SELECT DISTINCT word FROM parts', _NORMAL.format('original'), True)},{_tokens('one')} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, sha256(array_to_string(ids, ',')) AS ids_sha256 FROM one_i",
        "detokenize_roundtrip": f"""WITH RECURSIVE {_PROFILES},{_ALL_WORDS},{_paths('one', 'SELECT DISTINCT word FROM parts', _NORMAL.format('original'), True)},{_tokens('one')}
            SELECT d.doc_id, sha256(coalesce(t.text, '')) AS text_sha256 FROM one_i d
            LEFT JOIN (SELECT row, string_agg(substr(word, 2), ' ' ORDER BY pos) AS text FROM parts GROUP BY row) t USING (row) WHERE NOT list_contains(d.ids, 0)""",
        "token_lookup": f"WITH {_BASE} SELECT w.word AS token, w.n, b.id FROM words w LEFT JOIN base b ON b.piece = w.word",
        "id_lookup": f"WITH {_BASE} SELECT CAST(i AS INTEGER) AS id, coalesce(b.piece, CASE WHEN i = {voc.BASE_PIECES + 1} THEN '<blank>' END) AS token FROM range(-1, 2004) t(i) LEFT JOIN base b ON b.id = i",
        "ids_validate": f"""WITH {_PROFILES},
            off AS (SELECT list(id) AS ids FROM pieces WHERE profile = 'latin' AND NOT is_active),
            seqs AS (SELECT * FROM (VALUES {_values(sequences)}) t(row, ids) UNION ALL SELECT 8, [min(id)] FROM pieces WHERE profile = 'latin' AND NOT is_active)
            SELECT CAST(row AS INTEGER) AS row, CASE WHEN s.ids IS NULL OR len(list_filter(s.ids, lambda x: x IS NULL)) > 0 THEN 'null'
              WHEN len(list_filter(s.ids, lambda x: x < 0 OR x > {voc.BASE_PIECES + 1})) > 0 THEN 'range' WHEN list_has_any(s.ids, off.ids) THEN 'inactive' ELSE 'none' END AS fault FROM seqs s, off""",
        "coverage_by_lang": _two_profiles() + """
            SELECT lang, profile, count(*) AS records, count(*) FILTER (u > 0) AS unknown_records, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(u) AS BIGINT) AS unknown_tokens
            FROM (SELECT lang, 'original' AS profile, len(ids) AS n, len(list_filter(ids, lambda x: x = 0)) AS u FROM one_i
                  UNION ALL SELECT lang, 'latin', len(ids), len(list_filter(ids, lambda x: x = 0)) FROM two_i) GROUP BY lang, profile""",
        "retokenize_required": _two_profiles() + " SELECT a.doc_id, a.ids <> b.ids AS differs FROM one_i a JOIN two_i b USING (row)",
        "dominated_pieces": f"""WITH RECURSIVE {_BASE},
            p AS MATERIALIZED (SELECT id, piece, CAST(-ceil(id / 100) AS DOUBLE) AS score FROM base WHERE id > 0),
            e AS MATERIALIZED (SELECT o.piece AS word, s.b, s.b + s.l AS e, p.score FROM p o, LATERAL (SELECT l, unnest(generate_series(1, length(o.piece) - l + 1)) AS b FROM range(1, 5) t(l) WHERE l < length(o.piece)) s JOIN p ON p.piece = substr(o.piece, s.b, s.l)),
            r(word, pos, score) AS (SELECT piece, CAST(1 AS BIGINT), CAST(0 AS DOUBLE) FROM p UNION ALL SELECT r.word, e.e, max(r.score + e.score) FROM r JOIN e ON e.word = r.word AND e.b = r.pos GROUP BY r.word, e.e)
            SELECT p.id, p.piece, p.score, max(r.score) AS best FROM p JOIN r ON r.word = p.piece AND r.pos = length(p.piece) + 1 GROUP BY ALL HAVING max(r.score) > p.score""",
        "model_diff": f"""WITH {_PROFILES} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'missing' WHEN a.piece <> b.piece THEN 'piece' WHEN a.score <> b.score THEN 'score' ELSE 'type' END AS difference
            FROM (SELECT * FROM pieces WHERE profile = 'original') a FULL JOIN (SELECT * FROM pieces WHERE profile = 'latin-indic') b ON a.id = b.id
            WHERE a.id IS NULL OR b.id IS NULL OR a.piece <> b.piece OR a.score <> b.score OR a.type <> b.type""",
        "profile_faults": f"""WITH {_PROFILES} SELECT p.id, CASE WHEN p.type = 5 THEN 'placeholder' ELSE 'changed' END AS fault FROM pieces p WHERE p.profile = 'latin' AND p.id % 500 = 3""",
        "layout_faults": f"""WITH {_PROFILES},{_ROW_MAP},
            m AS (SELECT profile, count(*) FILTER (source_id <> t) AS moved, arg_max(t, source_id) AS last, count(*) AS n, max(source_id) AS high
                  FROM (SELECT *, target_id + CASE WHEN profile = 'full' AND source_id < 2 THEN 1 ELSE 0 END AS t FROM row_maps) GROUP BY profile),
            f AS (SELECT profile, count(*) AS slots, max(blank_id) AS blank, count(*) FILTER (is_active) AS active, count(*) FILTER (is_active) + CASE WHEN profile = 'latin' THEN 1 ELSE 0 END AS wanted FROM pieces GROUP BY profile)
            SELECT profile, unnest(list_filter([CASE WHEN blank <> slots THEN 'blank' END, CASE WHEN active <> wanted THEN 'active' END, CASE WHEN n <> high + 1 OR moved > 1 THEN 'map' END, CASE WHEN last <> blank THEN 'mapped blank' END], lambda x: x IS NOT NULL)) AS fault
            FROM f JOIN m USING (profile)""",
        "donor_paths": f"WITH RECURSIVE {_DONORS} SELECT added_id, array_to_string(path, ',') AS path FROM paths",
        "donor_loads": f"WITH RECURSIVE {_DONORS},{_LOADS} SELECT donor_id, CAST(load AS VARCHAR) AS load, (SELECT CAST(unit AS VARCHAR) FROM units) AS unit FROM loads",
        "donor_cmax": f"""WITH RECURSIVE {_DONORS},{_LOADS} SELECT 'retained_text_donor_mean_bound_v1' AS policy, added, added - fallbacks AS exact, fallbacks AS fallback, CAST(m AS VARCHAR) AS cmax_units, CAST(unit AS VARCHAR) AS unit,
            round(ln(0.05 / (CAST(m AS DOUBLE) / CAST(unit AS DOUBLE))), 9) AS shift FROM facts, units, (SELECT max(load) AS m FROM loads)""",
        "donor_means": f"""WITH {_STEPS} SELECT added_id AS row_id, CAST(dim AS INTEGER) AS dim, round(CAST(CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) + 0.0 AS x
            FROM (SELECT added_id, dim, x FROM (SELECT added_id, unnest(path) AS vec_id FROM steps) JOIN cells USING (vec_id)
                  UNION ALL SELECT added_id, dim, x FROM steps, cells WHERE len(path) = 0) GROUP BY added_id, dim""",
        "transfer_rows": "SELECT 'embedding' AS key, CAST(vec_id * 2 + k AS INTEGER) AS row_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INTEGER) AS n FROM embeddings, range(2) t(k)",
        "verify_transfer": "SELECT 'embedding' AS key, count(*) AS rows_checked, CAST(sum(len(embedding)) AS BIGINT) AS values_checked, CAST(sum(CASE WHEN (vec_id * 2 + 1) % 20 = 1 THEN len(embedding) ELSE 0 END) AS BIGINT) AS values_changed FROM embeddings",
        "failing_keys": "SELECT CASE WHEN count(*) FILTER ((vec_id * 2 + 1) % 20 = 1) > 0 THEN 'embedding' ELSE '' END AS failing FROM embeddings",
        "finite_rows": "SELECT 'embedding' AS key, CAST(vec_id AS INTEGER) AS row_id FROM embeddings WHERE vec_id % 50 IN (7, 9)",
        "masked_logits": f"WITH {_LOGITS} SELECT row, id, CASE WHEN id % 3 <> 1 THEN round(logit, 6) ELSE CAST('-infinity' AS DOUBLE) END AS logit FROM logits",
        "mass_ratio": f"WITH {_LOGITS} SELECT row, round(sum(exp(logit)) FILTER (id >= 30) / sum(exp(logit)) FILTER (id < 30), 6) AS ratio FROM logits GROUP BY row",
        "log_partition": f"WITH {_LOGITS} SELECT row, round(ln(sum(exp(logit))), 6) AS log_sum_exp FROM logits GROUP BY row",
        "prompt_slots": f"SELECT profile, CAST(slot AS INTEGER) AS slot, count(*) AS n_names, string_agg(name, ',' ORDER BY name) AS names FROM {registry} GROUP BY profile, slot",
        "unused_prompt_slots": f"SELECT DISTINCT t.profile, CAST(i AS INTEGER) AS slot FROM {registry}, range(128) u(i) WHERE (t.profile, i) NOT IN (SELECT (profile, slot) FROM {registry})",
        "document_tokens": f"""WITH RECURSIVE {_PROFILES},{_ALL_WORDS},{_paths('one', 'SELECT DISTINCT word FROM parts', _NORMAL.format('original'), True)},{_tokens('one')}
            SELECT any_value(d.doc_id) AS doc_id, sha256(coalesce(string_agg(b.piece, ' ' ORDER BY k), '')) AS tokens_sha256
            FROM one_i d LEFT JOIN (SELECT row, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM one_i) x USING (row) LEFT JOIN base b USING (id) GROUP BY row""",
        "token_sequences": f"WITH {_BASE} SELECT w.word AS k, b.id || ',' || c.id AS ids FROM words w JOIN base b ON b.piece = w.word JOIN base c ON c.piece = substr(w.word, 1, 2)",
        "addition_faults": f"WITH {_PROFILES} SELECT ord, CASE WHEN ord = 499 THEN 'missing' ELSE 'changed' END AS fault FROM added, base_size WHERE ord = 499 OR (s + ord) % 100 = 5",
        "donor_faults": f"""WITH {_BASE} SELECT * FROM (
            SELECT CASE WHEN id % 700 = 9 THEN 'same' ELSE piece END AS piece, 'score' AS fault FROM base WHERE id % 400 = 2 AND id <> 7
            UNION ALL SELECT '', 'empty' UNION ALL SELECT 'same', 'double')""",
        "row_map_faults": f"WITH {_PROFILES},{_ROW_MAP} SELECT source_id, CASE WHEN source_id = 11 THEN 'missing' ELSE 'target' END AS fault FROM row_maps WHERE profile = 'full' AND (source_id = 11 OR source_id % 600 = 3)",
        "shape_faults": "SELECT * FROM (SELECT 'fixed' AS key, 'rows' AS fault FROM embeddings WHERE vec_id = 0 UNION ALL SELECT 'gone', 'missing' UNION ALL SELECT 'thin', 'missing')",
        "network_faults": "SELECT 'weight' AS key, 'missing' AS fault UNION ALL SELECT DISTINCT 'bias', 'width' FROM embeddings WHERE len(embedding) > 1",
        "same_dictionary": f"""SELECT name, CAST(slot AS INTEGER) AS slot, side FROM (
            SELECT name, slot, 'left' AS side FROM {registry} WHERE profile = 'original' AND (name, slot) NOT IN (SELECT (name, slot) FROM {registry} WHERE profile = 'full' AND name <> 'hi')
            UNION ALL SELECT name, slot, 'right' FROM {registry} WHERE profile = 'full' AND name <> 'hi' AND (name, slot) NOT IN (SELECT (name, slot) FROM {registry} WHERE profile = 'original'))""",
        "mask_faults": "SELECT * FROM (VALUES ('latin', 'classes'), ('full', 'classes'), ('original', 'ids')) t(profile, fault)",
        "nbest_words": f"WITH RECURSIVE {_BASE},{_paths('dp', 'SELECT word FROM words', 'SELECT id, piece, score FROM base WHERE type = 1', False, 3)} SELECT word, CAST(k AS INTEGER) AS place, score, array_to_string(path, ',') AS path FROM dp",
        "digest_faults": """SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 13 = 2 THEN 'missing' WHEN doc_id % 7 = 3 THEN 'unexpected' ELSE 'digest' END AS fault FROM documents
            WHERE (doc_id % 13 = 2 AND doc_id % 7 <> 3) OR (doc_id % 13 <> 2 AND (doc_id % 7 = 3 OR doc_id % 11 = 5))""",
        "mass_shifts": "SELECT CAST(vec_id AS INTEGER) AS row_id, round(ln(0.05 / (vec_id + 1.5)), 9) AS shift FROM embeddings",
        "load_faults": f"WITH RECURSIVE {_DONORS},{_LOADS} SELECT CAST(sum(load) + 1 AS VARCHAR) AS total FROM loads",
        "left_out_rows": "SELECT 'embedding' AS key, count(*) AS rows_removed, CAST(sum(len(embedding)) AS BIGINT) AS values_omitted FROM embeddings WHERE vec_id % 3 = 1 OR vec_id % 5 = 2",
        "tokens_to_text": f"WITH {_BASE} SELECT w.word AS k, substr(w.word, 2) || ' ' || substr(w.word, 2, 1) AS text FROM words w JOIN base b ON b.piece = w.word JOIN base c ON c.piece = substr(w.word, 1, 2)",
        "content_digest": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "normalized_text": "SELECT doc_id, sha256(replace(coalesce(text, ''), 'f', 'fi')) AS text_sha256 FROM documents",
    }
