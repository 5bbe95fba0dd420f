"""Text expressions: normalisation, words, placeholders, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = "▁"
#: White space that separates words, and the boundary mark itself.
SEPARATOR = "[ \\t\\n\\r▁]+"

# Fixed value: the spelling of an inactive slot.
PLACEHOLDER = "<unused_nemotron_%d>"
BLANK = "<blank>"
UNKNOWN = "<unk>"
#: What an unknown token decodes to.
UNKNOWN_TEXT = " ⁇ "

_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94))


def normalized(text: Column) -> Column:
    """A subset of compatibility normalisation: full-width ASCII, the fi and fl ligatures, and the zero-width non-joiner as a space."""
    plain = F.translate(text, _WIDE, _NARROW)
    plain = F.replace(F.replace(plain, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.translate(plain, "‌　", "  ")


def text_words(text: Column) -> Column:
    """The words of a text, each with the boundary mark in front; null and empty texts have none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda w: w != "")
    return F.transform(parts, lambda w: F.concat(F.lit(BOUNDARY), w))


def placeholder(slot: Column) -> Column:
    """The spelling of inactive slot `slot`."""
    return F.format_string(PLACEHOLDER, slot)


def spoken(pieces: Column) -> Column:
    """The text that a sequence of piece spellings stands for."""
    return F.ltrim(F.replace(F.array_join(pieces, ""), F.lit(BOUNDARY), F.lit(" ")))


def digest(content: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(content, 256)
