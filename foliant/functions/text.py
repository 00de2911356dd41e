"""Text measures and normal forms as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.sources.workers import give_back

#: White space as Unicode has it, which the default classes of the regex engine lack; its characters.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\u0085\\u001C-\\u001F]"
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def estimate_tokens(text: Column) -> Column:
    """ceil(non-ASCII / 1.6 + ASCII / 4), at least 1; 0 for null or empty."""
    return tokens_of(F.length(text), wide_characters(text))


def wide_characters(text: Column) -> Column:
    """Characters beyond ASCII; a text of as many bytes as characters has none, and is not searched."""
    return F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.length(F.regexp_replace(text, "[\\x00-\\x7F]+", "")))


def tokens_of(n: Column, wide: Column) -> Column:
    """estimate_tokens() of a text of n characters, wide of them beyond ASCII."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(wide / 1.6 + (n - wide) / 4.0))).cast("int")


def document_mode(tokens: Column, compact: int = 6000, paged: int = 20000) -> Column:
    return F.when(tokens <= compact, "compact").when(tokens <= paged, "paged").otherwise("filtered")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def extractive_summary(text: Column, size: int = 180) -> Column:
    """White space collapsed; longer texts cut at size, right-trimmed, with three dots.

    One character more than size, white space aside, tells what is longer, so that only so much of a text is collapsed.
    """
    flat = collapse(F.regexp_extract(text, f"^(?:{SPACE}*+[^{SPACE[1:]}){{0,{size + 1}}}", 0))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("...")))


#: Rows whose normal forms are made at a time.
ROWS = 1 << 10


@F.arrow_udf(StringType())
def nfkc(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode NFKC, which has no built-in (that of Arrow composes nothing); few rows are Python's strings at a time, and memory goes back after each batch."""
    for part in parts:
        few = [part.slice(lo, ROWS) for lo in range(0, len(part), ROWS)] or [part]
        yield pa.concat_arrays([pa.array([x and normalize("NFKC", x) for x in each.to_pylist()], pa.string()) for each in few])
        del part, few
        give_back()


# Quotes and dashes that compare as ASCII ones.
_QUOTES, _PLAIN = "“”‘’—–－", "\"\"''---"


def normalize_text(text: Column, compatibility: bool = True) -> Column:
    """Compatibility form, plain quotes and dashes, no white space, no zero-width marks."""
    value = nfkc(text) if compatibility else text
    return F.regexp_replace(F.translate(value, _QUOTES, _PLAIN), f"{SPACE}|[\\u200B\\uFEFF]", "")


def ngrams(text: Column, n: int = 3) -> Column:
    """All n-grams with repetition; a shorter text is its own only one; none if empty."""
    size = F.length(text)
    all_grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.array().cast("array<string>")).when(size < n, F.array(text)).otherwise(all_grams)


# Characters of Chinese numbers in front of headings.
CHINESE_NUMBER = "一二三四五六七八九十百千万零〇两"


def normalize_number_spacing(text: Column) -> Column:
    """No blanks between a leading number and its mark: a Chinese or Arabic one and 、, an Arabic one and a dot."""
    text = F.regexp_replace(text, f"^([{CHINESE_NUMBER}]+|\\d+){SPACE}+、", "$1、")
    return F.regexp_replace(text, f"^(\\d+){SPACE}+\\.", "$1.")


def strip(text: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.trim(text, F.lit(BLANKS))


def truncate(text: Column, tokens: int, least: int, mark: str = "") -> Column:
    """A text of more estimated tokens cut in proportion to them, but to no fewer than least characters, with mark behind it."""
    own = estimate_tokens(text)
    size = F.greatest(F.lit(least), F.floor(F.length(text) * tokens / F.greatest(own, F.lit(1)))).cast("int")
    return F.when(own <= tokens, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), size), F.lit(BLANKS)), F.lit(mark)))
