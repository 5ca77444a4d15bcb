"""Tokens, trimming and TF-IDF weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space of a JavaScript regular expression. The low and the
# high characters are written in a form that both Java and RE2 read.
LOW_WHITE = r"\x09-\x0d\x20\x{00a0}"
HIGH_WHITE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# The outer range lets Java turn down ordinary characters with one comparison,
# which halves the time of splitting a text.
WHITE = rf"[{LOW_WHITE}[\x{{1680}}-\x{{feff}}&&[{HIGH_WHITE}]]]"


def trim_white(text: Column) -> Column:
    """Trim with the white-space class above (plain ``trim`` only knows U+0020)."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def tokens(text: Column) -> Column:
    """Lower-case words split at white space; punctuation stays, null gives no words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{WHITE}+", -1), "")


def raw_tokens(text: Column) -> Column:
    """Case-sensitive words with empty edges kept: the empty text has one (empty) word."""
    return F.split(F.coalesce(text, F.lit("")), f"{WHITE}+", -1)


def term_frequency(count: Column, total: Column) -> Column:
    """Share of a word among all words, 0 for an empty text or an absent word."""
    return F.when((total > 0) & (count > 0), count / total).otherwise(F.lit(0.0))


def inverse_document_frequency(df: Column, n: Column) -> Column:
    """``max(0, log2(n / (1 + df)))`` and 0 for an unknown word."""
    return F.when(df > 0, F.greatest(F.lit(0.0), F.log2(n / (df + F.lit(1))))).otherwise(F.lit(0.0))


def weight(frequency: Column, idf: Column) -> Column:
    """``log2(1 + tf) * idf``."""
    return F.log2(F.lit(1.0) + frequency) * idf


def cosine(dot: Column, left_norm: Column, right_norm: Column) -> Column:
    """Dot product over the product of the norms, 0 when a norm is 0."""
    scale = left_norm * right_norm
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot / scale)


def rank_boost(score: Column, rank: Column, boost: Column) -> Column:
    """Raise a score by ten times the page rank where ``boost`` holds."""
    return F.when(boost, score * (F.lit(1.0) + F.lit(10.0) * rank)).otherwise(score)


def clamp_limit(text: Column) -> Column:
    """Leading integer of a text, 10 if there is none or it is 0, kept within 1..50."""
    digits = F.regexp_extract(trim_white(F.coalesce(text, F.lit(""))), r"^([+-]?[0-9]+)", 1)
    number = F.nullif(digits.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    too_long = F.when(
        (F.length(digits) > 38) & number.isNull(), F.when(digits.startswith("-"), F.lit(1)).otherwise(F.lit(50))
    )
    parsed = F.coalesce(number, too_long.cast("decimal(38,0)"), F.lit(10).cast("decimal(38,0)"))
    # a number with a hexadecimal prefix is read as such; with more than two digits it is above the bounds
    hex_number = r"(?i)^([+-]?)0x0*([0-9a-f]+)"
    trimmed = trim_white(F.coalesce(text, F.lit("")))
    hex_digits = F.regexp_extract(trimmed, hex_number, 2)
    hex_value = F.when(F.length(hex_digits) > 2, F.lit(50)).otherwise(F.conv(hex_digits, 16, 10).cast("int"))
    negative = F.regexp_extract(trimmed, hex_number, 1) == "-"
    hex_limit = F.when(hex_value == 0, F.lit(10)).when(negative, F.lit(1)).otherwise(hex_value)
    parsed = F.when(hex_digits != "", hex_limit.cast("decimal(38,0)")).otherwise(parsed)
    return F.least(F.lit(50), F.greatest(F.lit(1), parsed)).cast("int")
