"""Column functions over text: white space, canonical names, word boundaries, escaping, plain phrases."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as Unicode knows it, for Java's regular expressions.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
# Words before a full stop that do not end a sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "etc", "inc", "ltd", "co", "fig", "eq", "no", "vol", "pp", "al", "st", "ave")
# Words that stand for a name and are never one.
PRONOUNS = ("i", "me", "my", "we", "us", "our", "you", "your", "he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "this", "that", "these", "those")
ARTICLES = ("the", "a", "an")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def lead(c: Column) -> Column:
    """How many white-space characters a text begins with."""
    return F.length(c) - F.length(F.regexp_replace(c, f"^{WS}+", ""))


@F.pandas_udf(StringType())
def _nfc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


def fold(c: Column) -> Column:
    """Composed and case-folded. Plain ASCII, the bulk of all rows, stays inside the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfc_fold(c)).otherwise(F.lower(c))


def match_fold(c: Column) -> Column:
    """Lower case for matching, only where it keeps every character's place; else the text as it is."""
    return F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(c)


def canonical_name(c: Column) -> Column:
    """The graph's name of a surface form: UPPER_SNAKE of its ASCII words without articles; '' where opaque.

    Opaque are ids: UUIDs, 32 or more hexadecimal digits, and bare numbers. Null gives null.
    """
    folded = fold(F.regexp_replace(strip(c), r"'s(?![\p{L}\p{N}_])", ""))
    ids = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9a-f]{32,}$|^[0-9]+$"
    words = lambda f: F.filter(F.split(f, "[^0-9a-z]+"), lambda w: (w != "") & ~w.isin(*ARTICLES))
    named = lambda f: let(F.upper(F.array_join(words(f), "_")), lambda n: F.when(n.rlike("^[0-9]+$"), F.lit("")).otherwise(n))
    return let(folded, lambda f: F.when(f.rlike(ids), F.lit("")).otherwise(named(f)))


def found_at(text: Column, pattern: str | Column) -> Column:
    """array<struct<at, found>> of all matches of a pattern and where they begin (0-based).

    Java's replace marks each match with a sign that no text holds; the pieces between the marks then give
    the places, since their lengths add up to them. Linear in the text, unlike taking substrings by place.
    """
    mark = "\u0002"
    whole = F.split(F.regexp_replace(text, pattern, F.lit(f"{mark}$0{mark}")), mark)
    step = F.aggregate(
        whole,
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.expr("cast(array() as array<struct<at:int,found:string>>)").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).cast("int").alias("at"), (~acc["hit"]).alias("hit"),
            F.when(acc["hit"], F.concat(acc["out"], F.array(F.struct(acc["at"].cast("int").alias("at"), p.alias("found"))))).otherwise(acc["out"]).alias("out")),
    )
    return step["out"]


def places_of(hay: Column, needle: Column) -> Column:
    """array<int> of all places (0-based, overlapping ones too) of a text in another; none for an empty needle."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    found = F.transform(found_at(hay, quoted), lambda h: h["at"])
    return F.when((needle != "") & F.contains(hay, needle), found).otherwise(F.expr("cast(array() as array<int>)"))


def is_pronoun(c: Column) -> Column:
    return F.lower(strip(c)).isin(*PRONOUNS)


def json_quoted(c: Column) -> Column:
    """A text as a JSON string literal, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def html_escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


# How a link's id reads in a sentence.
VERBS = {
    "WORKS_AT": "works at",
    "WORKS_FOR": "works for",
    "USES": "uses",
    "PART_OF": "is part of",
    "LOCATED_IN": "is located in",
    "LIVES_IN": "lives in",
    "DEPENDS_ON": "depends on",
    "CREATED_BY": "was created by",
    "HAPPENED_AT": "happened at",
    "KILL": "killed",
    "ORG_BASED_IN": "is based in",
    "FOUNDED": "founded",
    "ACQUIRED": "acquired",
    "INVESTED_IN": "invested in",
    "HEADQUARTERED_IN": "is headquartered in",
}


def pretty_name(c: Column) -> Column:
    """Canonical ids read as titled words; short capital words stay."""
    text = F.coalesce(strip(c), F.lit(""))
    shouting = (F.upper(text) == text) & text.rlike(r"\p{Lu}") & (F.length(text) > 4)
    titled = F.initcap(F.lower(F.replace(text, F.lit("_"), F.lit(" "))))
    return F.when(text == "", F.lit("something unnamed")).when(text.contains("_") | shouting, titled).otherwise(text)


def pretty_type(c: Column) -> Column:
    text = F.lower(strip(F.replace(F.coalesce(c, F.lit("name")), F.lit("_"), F.lit(" "))))
    return F.when(text == "", F.lit("name")).otherwise(text)


def link_phrase(source: Column, relation: Column, target: Column) -> Column:
    """One sentence that says a link in plain words."""
    code = F.upper(F.coalesce(relation, F.lit("")))
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    verb = F.coalesce(F.try_element_at(verbs, code), F.lower(F.replace(code, F.lit("_"), F.lit(" "))))
    s, t = pretty_name(source), pretty_name(target)
    none = F.concat(F.lit("No listed link from "), s, F.lit(" to "), t, F.lit("."))
    return F.when(code.isin("", "NONE", "NO_RELATION"), none).otherwise(F.concat(s, F.lit(" "), verb, F.lit(" "), t, F.lit(".")))


def percent_phrase(p: Column) -> Column:
    return F.when(p.isNull(), F.lit("")).otherwise(F.concat(F.lit(" The model put this at "), F.bround(p * 100).cast("int").cast("string"), F.lit("%.")))


def review_phrase(kind: Column, text: Column, type_: Column, source: Column, target: Column, prob: Column) -> Column:
    """What a person is asked about an item of the review queue."""
    name = pretty_type(type_)
    article = F.when(F.substring(name, 1, 1).isin(*"aeiou"), F.lit("an")).otherwise(F.lit("a"))
    entity = F.concat(F.lit("Check whether “"), F.coalesce(text, F.lit("this mention")), F.lit("” is "), article, F.lit(" "), name, F.lit("."), percent_phrase(prob))
    s, t = pretty_name(source), pretty_name(target)
    unknown = F.concat(F.lit("Check whether any real link holds from "), s, F.lit(" to "), t, F.lit("."))
    known = F.concat(F.lit("Check this possible link: "), link_phrase(source, type_, target))
    code = F.upper(F.coalesce(type_, F.lit("")))
    relation = F.concat(F.when(code.isin("", "NONE", "NO_RELATION"), unknown).otherwise(known), percent_phrase(prob))
    other = F.lit("A person should look at this item before it is written into the graph.")
    return F.when(kind == "entity", entity).when(kind == "relation", relation).otherwise(other)


def time_phrase(ms: Column) -> Column:
    seconds = ms / 1000
    long = F.concat(F.format_string("%.1f", seconds), F.when(F.abs(seconds - 1) < 0.05, F.lit(" second")).otherwise(F.lit(" seconds")))
    short = F.concat(ms.cast("string"), F.when(ms == 1, F.lit(" millisecond")).otherwise(F.lit(" milliseconds")))
    return F.when(ms >= 1000, long).otherwise(short)
