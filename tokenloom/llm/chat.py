"""Chat formatting with loss masks aligned to token offsets (operator 5).

A conversation is rendered whole as

    <|turn|>role<|text|>text<|end|>

turn after turn, encoded once with offsets, and a token is under the loss mask
when it meets the text of an assistant turn: the sorted spans of those texts
are laid over the sorted token spans by binary search. The three marks are
special tokens, so tokens never cross the border of a text. In roles and texts
a backslash is written as two and "<|" as "<\\|", which no mark can be taken
for and which `unescape` reverts.

Null roles and texts are empty, null turns come first, equal turns are ordered
by role and text, and repeated rows are turns of their own. Rows with a null
conv_id form one conversation. An empty table gives an empty result; other
columns are ignored. A conversation of over `part_chars` characters comes out as
several rows cut between turns (tokens are the same, as marks stand alone), so
a task never holds more than a part and one turn.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART_CHARS = 1 << 20
BATCH_CHARS = 1 << 20
LEARNT_ROLE = "assistant"
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return s if "\\" not in s else re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


def render(role: str | None, text: str | None) -> str:
    """One turn as the template writes it."""
    return f"{TURN}{escape(role or '')}{TEXT}{escape(text or '')}{END}"


def learnt_spans(rendered: str) -> np.ndarray:
    """Sorted (start, end) of the assistant texts in rendered turns."""
    found = [m.span(2) for m in _TURN.finditer(rendered) if unescape(m.group(1)) == LEARNT_ROLE]
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def mask(token_spans: np.ndarray, text_spans: np.ndarray) -> np.ndarray:
    """Which tokens meet a text span; both arrays of (start, end) are sorted."""
    out = np.zeros(len(token_spans) + 1, dtype=np.int64)
    full = text_spans[text_spans[:, 0] < text_spans[:, 1]]
    first = np.searchsorted(token_spans[:, 1], full[:, 0], side="right")
    last = np.searchsorted(token_spans[:, 0], full[:, 1], side="left")
    np.add.at(out, first, 1)
    np.add.at(out, last, -1)
    return np.cumsum(out)[:-1] > 0


_ENCODERS: dict[str, object] = {}


def _encoder(model: bytes):
    import os

    key = hashlib.sha256(model).hexdigest()
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        tok = Tokenizer.from_str(model.decode())
        tok.post_processor = processors.ByteLevel(trim_offsets=False)
        tok.add_special_tokens([TURN, TEXT, END])
        # a byte-level piece spells a byte in each of its characters, a mark itself
        pieces = tok.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
        size = np.zeros(max(pieces.values()) + 1, dtype=np.int64)
        for piece, i in pieces.items():
            size[i] = len(added[i].encode()) if i in added else len(piece)
        _ENCODERS[key] = tok, size
    return _ENCODERS[key]


def encoded(texts: list[str], model: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ids of each text, and the start and end of every token in the characters of all texts back to back.

    A token that holds a part of a character's bytes spans the whole character.
    """
    tok, size = _encoder(model)
    ids = [np.array(e.ids, dtype=np.int32) for e in tok.encode_batch(texts, add_special_tokens=False)]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    ends = np.cumsum(size[np.concatenate(ids)]) if ids else np.zeros(0, np.int64)
    bounds, wanted = np.cumsum([len(x) for x in ids]), np.cumsum([len(t.encode()) for t in texts])
    if (np.append(0, ends)[bounds] != wanted).any():
        raise ValueError("the tokenizer does not keep every byte of its text")
    character = np.cumsum((raw & 0xC0) != 0x80)
    begins = np.append(0, ends)[:-1]
    return ids, character[begins] - 1, character[ends - 1]


_PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.large_string()), ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("token_start", pa.list_(pa.int32())), ("token_end", pa.list_(pa.int32()))])


def format_conversations(rows: DataFrame, model: bytes, part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted conversations: conv_id, part, formatted, input_ids, loss_mask, token_start, token_end.

    Offsets are in characters of `formatted`. Parts of a conversation follow
    one another in one partition of the result.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    plain = common.renamed(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches):
        def coded(parts):
            conv, number, texts = zip(*parts)
            ids, start, end = encoded(list(texts), shared.value)
            first = np.cumsum([0, *(len(t) for t in texts)])
            learnt = np.concatenate([learnt_spans(t) + at for t, at in zip(texts, first.tolist())])
            on = mask(np.stack([start, end], axis=1), learnt)
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            start, end = start - np.repeat(first[:-1], np.diff(cuts)), end - np.repeat(first[:-1], np.diff(cuts))

            def lists(values, kind):
                return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))

            columns = [pa.array(conv, pa.int64()), pa.array(number, pa.int32()), pa.array(texts, pa.large_string())]
            return pa.RecordBatch.from_arrays([*columns, lists(np.concatenate(ids), pa.int32()), lists(on, pa.bool_()), lists(start, pa.int32()), lists(end, pa.int32())], schema=_PART)

        ready, held = [], 0
        conv, number, turns, size = None, -1, [], 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if number < 0 or c != conv or size >= part_chars:
                    if turns:
                        ready.append((conv, number, "".join(turns)))
                        held += size
                    number = number + 1 if number >= 0 and c == conv else 0
                    conv, turns, size = c, [], 0
                    if held >= BATCH_CHARS:
                        yield coded(ready)
                        ready, held = [], 0
                turns.append(render(role, text))
                size += len(turns[-1])
        if turns:
            ready.append((conv, number, "".join(turns)))
        if ready:
            yield coded(ready)

    return dealt.transform(common.batches, work, "conv_id bigint, part int, formatted string, input_ids array<int>, loss_mask array<boolean>, token_start array<int>, token_end array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold: turns and their digest, the text under the mask and its digest.

    Expects the parts of a conversation in order in one partition, as
    format_conversations gives them.
    """

    def work(batches):
        out, state = [], None

        def closed(s):
            return {"conv_id": s["conv_id"], "n_turns": s["turns"], "turns_sha256": s["all"].hexdigest(), "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["size"], "n_tokens": s["tokens"], "n_loss_tokens": s["masked"]}

        for batch in batches:
            for i in range(batch.num_rows):
                conv, part, text = (batch.column(k)[i].as_py() for k in range(3))
                on, start, end = (np.asarray(batch.column(k)[i].values) for k in (4, 5, 6))
                if part == 0:
                    if state:
                        out.append(closed(state))
                    state = {"conv_id": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0, "tokens": 0, "masked": 0}
                for m in _TURN.finditer(text):
                    state["turns"] += 1
                    state["all"].update(f"{unescape(m.group(1))}\n{unescape(m.group(2))}\n".encode())
                # runs of masked tokens; bytes of one character may come as several tokens of one span
                edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
                for a, b in zip(start[np.flatnonzero(edge == 1)], end[np.flatnonzero(edge == -1) - 1]):
                    learnt = unescape(text[a:b])
                    state["chars"] += len(learnt)
                    state["loss"].update(learnt.encode())
                state["size"] += len(text)
                state["tokens"] += len(on)
                state["masked"] += int(on.sum())
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, _READ)
                out = []
        if state:
            out.append(closed(state))
        if out:
            yield pa.RecordBatch.from_pylist(out, _READ)

    return formatted.transform(common.batches, work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    from tokenloom.llm.sentencepieces import default_model

    odd = "\\### Assistant: </turn> ok"
    rows = common.renamed(common.table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    done = read_back(format_conversations(rows.unionByName(more), default_model("byte_bpe_50k.json")))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: The marks of a turn have 23 characters; each backslash and each "<|" of a role or text adds one.
ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(k))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
