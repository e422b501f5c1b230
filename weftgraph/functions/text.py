"""Text operations as column expressions; all of them stay inside the JVM unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed
from .fixed import DOTS, QUALIFIER, QUOTE_BREAK, QUOTES, SENTENCE_BREAK

TRIM = r"^\s+|\s+$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, TRIM, "")


def trimmed_body(body: Column) -> Column:
    """A body up to the first heading of its closing sections."""
    cut = F.regexp_replace(body, rf"(?ms)^\s*(?:{fixed.SECTION_CUT.split('(', 1)[1].rsplit(')', 1)[0]})\s*$.*\z", "")
    return F.when(body.rlike(f"(?m){fixed.SECTION_CUT}"), F.regexp_replace(cut, r"\s+$", "")).otherwise(body)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition: Spark has no built-in for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def unified(name: Column) -> Column:
    """Dots and white space in one form, quotes taken out."""
    name = F.regexp_replace(F.regexp_replace(stripped(F.coalesce(name, F.lit(""))), DOTS, "·"), QUOTES, "")
    return stripped(F.regexp_replace(F.regexp_replace(name, r"\s*·\s*", "·"), r"\s+", " "))


def gloss(name: Column) -> Column:
    """The Han characters in brackets, without white space; null if there are none."""
    return bound(F.regexp_extract(unified(name), fixed.NAME_GLOSS, 1), lambda found: F.when(found != "", F.regexp_replace(found, r"\s+", "")))


def normalized(name: Column) -> Column:
    """The standard form of a name: unified, without bracketed qualifiers unless nothing else is left."""
    plain = bound(unified(name), lambda one: bound(stripped(F.regexp_replace(one, QUALIFIER, "")), lambda bare: F.when(bare != "", bare).otherwise(one)))
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"^[ ,;·]+|[ ,;·]+$", "")


def normalization_rules(name: Column) -> Column:
    """Which rules changed a name, as an array."""
    one = unified(name)
    bare = stripped(F.regexp_replace(one, QUALIFIER, ""))
    rules = F.array(
        F.when(one != stripped(F.coalesce(name, F.lit(""))), F.lit("whitespace")),
        F.when(gloss(name).isNotNull(), F.lit("gloss")),
        F.when((bare != "") & (bare != one) & gloss(name).isNull(), F.lit("qualifier")),
    )
    return F.array_compact(rules)


def without_particle(word: Column) -> Column:
    """A word without its longest final particle, if something is left of it."""
    ordered = sorted(fixed.QUESTION_PARTICLES, key=len, reverse=True)
    return F.regexp_replace(word, rf"(?s)(?<=.)(?:{'|'.join(ordered)})\z", "")


def without_name_particle(word: Column) -> Column:
    """A name without its particle, if two characters or more are left; the shortest such stem."""
    stem = F.regexp_extract(stripped(word), rf"^(.*?)(?:{fixed.NAME_PARTICLES})$", 1)
    return F.when(F.length(stem) >= 2, stem).otherwise(stripped(word))


def sentences(text: Column, least: int = 8) -> Column:
    """Sentences of a text in order, without list marks at the ends and short or header ones."""
    cut = F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.regexp_replace(s, r"^[ \t·\-—=*]+|[ \t·\-—=*]+$", ""))
    return F.filter(cut, lambda s: (F.length(s) >= least) & ~F.startswith(s, F.lit("[문서 ")))


def quotable(text: Column, least: int = 15) -> Column:
    """Sentences long enough to quote."""
    return F.filter(F.transform(F.split(text, QUOTE_BREAK), stripped), lambda s: F.length(s) >= least)


def chunks(text: Column, size: int = 800, overlap: int = 150, least: int = 40) -> Column:
    """Overlapping windows of a text: structs of offset and chunk."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(max(50, size - overlap)))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("offset"), stripped(F.substring(text, i + 1, F.lit(size))).alias("chunk")))
    return F.filter(cut, lambda c: F.length(c["chunk"]) >= least)


def _part_of(text: Column, size: int) -> Callable[[Column], Column]:
    return lambda i: F.substring(text, i, F.lit(size))


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside space-padded words, repeats included; a word shorter than n counts once for it."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        arrays = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), _part_of(padded, n)) for n in range(low, high + 1)]
        # Longer n-grams of a word that the last one covered whole are the same string again.
        kept = [arrays[0], *(F.when(F.length(padded) >= n, a).otherwise(F.array().cast("array<string>")) for n, a in zip(range(low + 1, high + 1), arrays[1:], strict=True))]
        return F.concat(*kept)

    return F.flatten(F.transform(words, of))


def words(text: Column, pattern: str = "[가-힣A-Za-z0-9]{2,}") -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def evidence(text: Column, most: int = 200) -> Column:
    """A quotation cut to its greatest length."""
    text = stripped(text)
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(text)


def masked(secret: Column) -> Column:
    """A key for display: its ends, or only stars if it is short."""
    long_ = F.concat(F.substring(secret, 1, 3), F.lit("*" * 8), F.substring(secret, -4, 4))
    return F.when(F.length(secret) > 10, long_).otherwise(F.repeat(F.lit("*"), F.length(secret)))


def key_like(secret: Column) -> Column:
    return secret.rlike(r"^sk-[A-Za-z0-9_\-]{20,}$")


def cache_key(*columns: Column) -> Column:
    """A digest of named columns in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def json_payload(text: Column) -> Column:
    """The JSON of an answer: without a code fence, from its first bracket to the last."""
    bare = stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    span = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.when(bare.rlike(r"^[\[{]"), bare).when(span != "", span)


def excerpt(text: Column, most: int = 300) -> Column:
    """The beginning of a text on one line."""
    return stripped(F.regexp_replace(F.substring(text, 1, most), "\n", " "))


def file_name(title: Column) -> Column:
    return F.concat(F.regexp_replace(F.replace(title, F.lit(" "), F.lit("_")), r'[\\/:*?"<>|]', "_"), F.lit(".md"))
