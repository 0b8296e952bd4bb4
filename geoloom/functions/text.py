"""Address text: normalisation, tokens, house numbers and the closest-grammar, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: How letters of U+00C0 to U+00FF are written; the block's other characters become a space.
FOLDED = {"ae": "äÄ", "oe": "öÖ", "ue": "üÜ", "ss": "ß"}
PLAIN = {"a": "àáâãåæ", "e": "èéêë", "i": "ìíîï", "o": "òóôõ", "u": "ùúû", "n": "ñ", "c": "ç"}
#: Abbreviations at the end of a run of letters and digits.
ABBREVIATIONS = {"str": "strasse", "pl": "platz", "rd": "road", "ave": "avenue"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalize_address(text: Column) -> Column:
    """Folded to plain lower-case words with abbreviations written out. Only ASCII letters change case."""
    for to, letters in FOLDED.items():
        text = F.regexp_replace(text, f"[{letters}]", to)
    text = F.translate(text, "".join(PLAIN.values()) + UPPER, "".join(k * len(v) for k, v in PLAIN.items()) + LOWER)
    text = F.regexp_replace(text, "[À-ÿ!-/:-@\\[-`{-~ \\t\\n\\x0B\\f\\r]+", " ")
    text = F.trim(text)
    for short, long in ABBREVIATIONS.items():
        text = F.regexp_replace(text, f"{short}(?![0-9a-z])", long)
    return text


def tokens(normalized: Column) -> Column:
    """The words of a normalised text; none for a null."""
    return F.filter(F.split(F.coalesce(normalized, F.lit("")), " "), lambda t: t != "")


def house_number(raw: Column) -> Column:
    """The leading ASCII digits as a number up to 65535, else null."""
    digits = F.regexp_replace(F.regexp_extract(raw, "^([0-9]+)", 1), "^0+(?=[0-9])", "")
    number = F.when(F.length(digits).between(1, 5), digits).try_cast("int")
    return F.when(number <= 65535, number)


def parse_closest(words: Column) -> Column:
    """struct(from_tokens, to_tokens) of `closest X to Y`; plain searches have no to_tokens.

    Without `to`, or with nothing before it, both are empty."""
    none = F.array().cast("array<string>")
    at = F.array_position(words, F.lit("to")).cast("int")
    is_closest = F.coalesce(F.get(words, F.lit(0)) == "closest", F.lit(False))
    bad = is_closest & (at <= 2)
    before = F.slice(words, F.lit(2), F.greatest(at - 2, F.lit(0)))
    after = F.slice(words, F.greatest(at + 1, F.lit(1)), F.greatest(F.size(words) - at, F.lit(0)))
    return F.struct(
        F.when(bad, none).when(is_closest, before).otherwise(words).alias("from_tokens"),
        F.when(bad | ~is_closest, none).otherwise(after).alias("to_tokens"),
    )
