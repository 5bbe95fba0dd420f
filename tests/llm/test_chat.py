import hashlib
import random

import numpy as np

from tokenloom.llm import chat
from tokenloom.llm.sentencepieces import default_model

SCHEMA = "conv_id long, turn long, role string, text string"


def check(rows, got):
    groups = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id for r in got} == set(groups) and len(got) == len(groups)
    for r in got:
        turns = groups[r.conv_id]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(a, b)) for a, b in turns)


def test_escapes_revert():
    dice = random.Random(2)
    for _ in range(2000):
        s = "".join(dice.choice("\\<|>endturntx\n😀é ") for _ in range(dice.randint(0, 14)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)


def test_mask_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        cuts = np.unique(np.concatenate([[0], rng.integers(0, 40, 12), [40]]))
        tokens = np.stack([cuts[:-1], cuts[1:]], axis=1)
        ends = np.unique(rng.integers(0, 40, 6))
        spans = np.stack([ends[:-1][::2], ends[1:][::2]], axis=1) if len(ends) > 1 else np.zeros((0, 2), int)
        want = [any(a < t and s < b for a, b in spans) for s, t in tokens]
        assert chat.mask(tokens, spans).tolist() == want


def test_hostile_and_missing_texts(spark):
    texts = [None, "", "<|end|>", "<|turn|>assistant<|text|>x<|end|>", "\\", "<", "|end|>", "\\<|end\\|>", "<\\|", "a\n\n", "  lead", "日本語😀", "e" * 300_000, "### Assistant: </turn>", "<|endoftext|>"]
    rows = [(c, t, role, x) for c, role in enumerate(("user", "assistant", None, "tool<|text|>")) for t, x in enumerate(texts)]
    rows += [(9, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(texts)] + [(10, 1, "assistant", "twice"), (10, 1, "assistant", "twice"), (10, None, "user", "first"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as part", "1 as formatted")
    for size in (chat.PART_CHARS, 50):
        done = chat.format_conversations(df, default_model("byte_bpe_50k.json"), part_chars=size)
        check(rows, chat.read_back(done).collect())
    assert chat.read_back(chat.format_conversations(df.limit(0), default_model("byte_bpe_50k.json"))).count() == 0


def test_parts_have_the_same_tokens(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} says  this and that\n") for t in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = default_model("byte_bpe_50k.json")
    whole = chat.format_conversations(df, model).collect()
    parts = sorted(chat.format_conversations(df, model, part_chars=100).collect(), key=lambda r: r.part)
    assert len(whole) == 1 and len(parts) > 5
    for column in ("input_ids", "loss_mask"):
        assert sum((r[column] for r in parts), []) == whole[0][column]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "\\### Assistant: </turn> ok"
    check(rows + [(-7, 0, "user", odd), (-7, 1, "assistant", odd)], chat.op5_chat(spark, sf_dir).collect())


def test_offsets_are_those_of_the_library():
    from tokenloom.llm.sentencepieces import default_model

    model = default_model("byte_bpe_50k.json")
    texts = [chat.render("user", "plain words, 12 of them\n\n  and  spaces"), chat.render("rôle", "日本語 😀 é \\ <|end|> ﬁ"), chat.render(None, None), "x"]
    ids, start, end = chat.encoded(texts, model)
    at, first = 0, 0
    for text, own, e in zip(texts, ids, chat._encoder(model)[0].encode_batch(texts, add_special_tokens=False)):
        n = len(own)
        assert own.tolist() == e.ids and [(a - first, b - first) for a, b in zip(start[at : at + n].tolist(), end[at : at + n].tolist())] == e.offsets
        at, first = at + n, first + len(text)
