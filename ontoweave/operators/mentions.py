"""Candidate spans in sentences: listed names, markup cues, capitalised runs, pronouns, encoder spans; their merge.

A sentence frame has document_id, sentence_id, text, start_char and heading_path; a mention frame
(``COLUMNS``) has absolute code-point offsets. Null and empty sentences propose nothing; repeated sentences
propose the same mentions again, so callers keep sentence ids unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PRONOUNS, found_at, is_pronoun, match_fold, places_of, strip

COLUMNS = ("document_id", "sentence_id", "text", "start_char", "end_char", "source", "skipped_reason", "heading_path")
# Words that join two capitalised words to one name.
CONNECTORS = ("of", "de", "van", "von", "da", "del")
# Words that are capitalised only where they open a sentence, or are never names.
OPENERS = (
    "a an the this that these those it its they them their he she his her we our you your i in on at of for to from by with and or but if as is are was were be been being after before when while then there here also "
    "however though although because since until not no yes all any some each every both many most other another such what which who whom one two three first second third new old more less last next today yesterday "
    "tomorrow january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday figure table section abstract introduction conclusion "
    "furthermore moreover finally specifically additionally overall instead thus therefore during"
).split()


def _mention(local_start: Column, text: Column, source: str, skipped: Column | None = None) -> list[Column]:
    clean = strip(text)
    reason = F.when(is_pronoun(text), F.lit("pronoun")) if skipped is None else skipped
    return [
        F.col("document_id"), F.col("sentence_id"), clean.alias("text"), (F.col("start_char") + local_start).cast("int").alias("start_char"),
        (F.col("start_char") + local_start + F.length(text)).cast("int").alias("end_char"), F.lit(source).alias("source"),
        reason.cast("string").alias("skipped_reason"), F.col("heading_path")]


def markdown_cues(sentences: DataFrame) -> DataFrame:
    """Names set in bold, as link texts or as code."""
    rows = None
    for pattern, opening in ((r"\*\*[^*]+\*\*|__[^_]+__", 2), (r"\[[^\]]+\]\([^)]+\)", 1), (r"`[^`]+`", 1)):
        hits = sentences.select(*sentences.columns, F.explode(found_at(F.col("text"), pattern)).alias("h"))
        inner = F.regexp_extract("h.found", {2: r"^(?:\*\*|__)(.+?)(?:\*\*|__)$", 1: r"^[\[`](.+?)[\]`]"}[opening], 1)
        part = hits.select(*_mention(F.col("h.at") + opening, inner, "markdown"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def pronouns(sentences: DataFrame) -> DataFrame:
    """Pronouns, whole words in any case; they are kept but never typed."""
    ordered = "|".join(sorted(PRONOUNS, key=len, reverse=True))
    pattern = rf"(?<![\p{{L}}\p{{N}}_])(?i:{ordered})(?![\p{{L}}\p{{N}}_])"
    hits = sentences.select(*sentences.columns, F.explode(found_at(F.col("text"), pattern)).alias("h"))
    return hits.select(*_mention(F.col("h.at"), F.col("h.found"), "shape", F.lit("pronoun")))


def capital_runs(sentences: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Runs of capitalised words, joined by blanks or one connector, without opening words and possessives.

    Runs that overlap a mention of ``taken`` (the listed names) are none.
    """
    word = r"\p{Lu}[\p{L}\p{N}&.\-]*[\p{L}\p{N}]|\p{Lu}"
    join = rf"(?: (?:{'|'.join(CONNECTORS)}))? "
    pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{word})(?:{join}(?:{word}))*(?![\p{{L}}\p{{N}}_])"
    opener = rf"^(?i:(?:{'|'.join(OPENERS)}) )+"
    hits = sentences.select(*sentences.columns, F.explode(found_at(F.col("text"), pattern)).alias("h"))
    cut = F.length(F.col("h.found")) - F.length(F.regexp_replace("h.found", opener, ""))
    rest = F.regexp_replace(F.regexp_replace("h.found", opener, ""), r"['’]s$", "")
    ok = (F.length(rest) >= 2) & ~F.lower(rest).isin(*OPENERS)
    runs = hits.where(ok).select(*_mention(F.col("h.at") + cut, rest, "shape"))
    return runs if taken is None else clear_of(runs, taken)


def masked(sentences: DataFrame, taken: DataFrame) -> DataFrame:
    """sentences with blanks in place of the mentions ``taken``, so that all else keeps its place."""
    keys = ["document_id", "sentence_id"]
    spans = taken.groupBy(*keys).agg(F.collect_list(F.struct("start_char", "end_char")).alias("_taken"))
    at = lambda t, c: t[c] - F.col("start_char")
    blank = F.aggregate(
        F.coalesce("_taken", F.expr("cast(array() as array<struct<start_char:int,end_char:int>>)")), F.col("text"),
        lambda acc, t: F.concat(acc.substr(F.lit(1), at(t, "start_char")), F.repeat(F.lit(" "), at(t, "end_char") - at(t, "start_char")), acc.substr(at(t, "end_char") + 1, F.length(acc))))
    return sentences.join(spans, keys, "left").withColumn("text", blank).drop("_taken")


def clear_of(mentions: DataFrame, taken: DataFrame) -> DataFrame:
    """Mentions that overlap none of ``taken`` in their sentence."""
    keys = ["document_id", "sentence_id"]
    spans = taken.groupBy(*keys).agg(F.collect_list(F.struct("start_char", "end_char")).alias("_taken"))
    rows = mentions.join(spans, keys, "left")
    hit = F.exists("_taken", lambda t: (t["start_char"] < F.col("end_char")) & (F.col("start_char") < t["end_char"]))
    return rows.where(~F.coalesce(hit, F.lit(False))).select(*mentions.columns)


def listed_names(sentences: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Listed names in sentences: any case, bounded by no letter or digit, longest names first, no overlaps.

    Names are found by an equi-join on the folded text of all word runs of a sentence that are as long as some name,
    from the first to the last letter or digit; names without any are looked for among the sentence's runs of signs.
    Only keys, places and the run itself go into the join, so it grows with the words of the text, not with names x
    sentences, whether Spark broadcasts the names (their size decides) or shuffles both sides. Signs around a name
    and its bounds are then compared in the sentence.
    """
    letter = r"[\p{L}\p{N}]"
    keys = ["document_id", "sentence_id"]
    names = gazetteer.select(match_fold(F.col("name")).alias("needle"), F.col("ord").cast("long").alias("name_ord")).where(F.col("needle") != "")
    core = F.regexp_replace("needle", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    names = names.groupBy("needle").agg(F.min("name_ord").alias("name_ord")).withColumn("core", core)
    worded = F.col("core") != ""
    names = names.select(
        "needle", "name_ord", F.when(worded, F.col("core")).otherwise(F.col("needle")).alias("run"), F.when(worded, F.length(F.regexp_extract("needle", r"^[^\p{L}\p{N}]*", 0))).otherwise(0).alias("lead"),
        F.when(worded, F.regexp_count("needle", F.lit(rf"{letter}+"))).alias("n_words"), F.when(~worded, F.length("needle")).alias("n_signs"))
    sizes = names.agg(F.array_sort(F.collect_set("n_words")).alias("n_words"), F.array_sort(F.collect_set("n_signs")).alias("n_signs"))  # one row
    rows = sentences.select(*keys, match_fold(F.col("text")).alias("hay")).where(F.col("hay") != "").crossJoin(F.broadcast(sizes))
    rows = rows.select(*keys, "hay", "n_words", "n_signs", F.explode(F.array(found_at(F.col("hay"), rf"{letter}+"))).alias("w"))
    empty = F.expr("cast(array() as array<struct<begin:int,run:string>>)")
    piece = lambda begin, upto: F.struct(begin.cast("int").alias("begin"), F.col("hay").substr(begin + 1, upto - begin).alias("run"))
    last = lambda i, n: F.get("w", i + n - 1)
    of_words = F.flatten(F.transform("w", lambda x, i: F.transform(F.filter("n_words", lambda n: i + n <= F.size("w")), lambda n: piece(x["at"], last(i, n)["at"] + F.length(last(i, n)["found"])))))
    inside = lambda x, n: F.transform(F.sequence(F.lit(0), F.length(x["found"]) - n), lambda k: piece(x["at"] + k, x["at"] + k + n))
    of_signs = F.flatten(F.transform(found_at(F.col("hay"), r"[^\p{L}\p{N}]+"), lambda x: F.flatten(F.transform(F.filter("n_signs", lambda n: n <= F.length(x["found"])), lambda n: inside(x, n)))))
    runs = rows.select(*keys, F.explode(F.concat(of_words, F.when(F.size("n_signs") > 0, of_signs).otherwise(empty))).alias("r")).select(*keys, "r.begin", "r.run")
    hits = runs.join(names.select("run", "needle", "name_ord", "lead"), "run")
    at = (F.col("begin") + 1 - F.col("lead")).cast("int")
    span = F.struct((-F.length("needle")).cast("int").alias("rank"), "name_ord", at.alias("at"), (at + F.length("needle")).cast("int").alias("upto"), "needle")
    per = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("spans")).join(sentences, keys)
    text, folded = F.col("text"), match_fold(F.col("text"))
    is_letter = lambda c: c.rlike(letter)
    bounded = lambda s: ((s["at"] == 1) | ~is_letter(text.substr(s["at"] - 1, F.lit(1)))) & ((s["upto"] > F.length(text)) | ~is_letter(text.substr(s["upto"], F.lit(1))))
    stands = lambda s: (s["at"] > 0) & (folded.substr(s["at"], F.length(s["needle"])) == s["needle"]) & bounded(s)
    kept = F.aggregate(
        F.filter("spans", stands), F.expr("cast(array() as array<struct<rank:int,name_ord:bigint,at:int,upto:int,needle:string>>)"),
        lambda acc, s: F.when(F.exists(acc, lambda k: (s["at"] < k["upto"]) & (k["at"] < s["upto"])), acc).otherwise(F.concat(acc, F.array(s))))
    out = per.select(*sentences.columns, F.explode(kept).alias("s"))
    return out.select(*_mention(F.col("s.at") - 1, text.substr(F.col("s.at"), F.col("s.upto") - F.col("s.at")), "gazetteer"))


def encoder_spans(sentences: DataFrame, encode: Callable[[Iterator[pd.Series]], Iterator[list[list[tuple[int, int, float]]]]], threshold: float) -> DataFrame:
    """Spans of a pluggable model: ``encode`` maps batches of texts to lists of (start, end, score) each.

    Labels are not used; spans out of bounds or below the threshold are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = next(encode(iter([pdf["text"]])))
            rows = [(d, s, t[a:b], n + a, n + b, p) for d, s, t, n, p, spans in zip(pdf.document_id, pdf.sentence_id, pdf.text, pdf.start_char, pdf.heading_path, found)
                    for a, b, score in spans if score >= threshold and 0 <= a < b <= len(t)]
            yield pd.DataFrame(rows, columns=["document_id", "sentence_id", "text", "start_char", "end_char", "heading_path"])

    schema = "document_id string, sentence_id string, text string, start_char int, end_char int, heading_path array<string>"
    out = sentences.select("document_id", "sentence_id", "text", "start_char", "heading_path").where(F.col("text") != "").mapInPandas(run, schema)
    reason = F.when(is_pronoun(F.col("text")), F.lit("pronoun")).cast("string")
    return out.select("document_id", "sentence_id", strip(F.col("text")).alias("text"), "start_char", "end_char", F.lit("encoder").alias("source"), reason.alias("skipped_reason"), "heading_path")


def merge(mentions: DataFrame, keys: tuple[str, ...] = ("document_id", "sentence_id")) -> DataFrame:
    """Overlapping mentions of a sentence to the longest ones; on one span the first source by name stays.

    Mentions with a skipped_reason are kept as they are. Adds ``m_ord``, the place in the sentence.
    """
    span = F.struct(F.col("start_char").alias("a"), (F.col("start_char") - F.col("end_char")).alias("rank"), F.col("source").alias("src"), F.col("end_char").alias("b"), F.col("text").alias("text"))
    live = mentions.where(F.col("skipped_reason").isNull())
    empty = F.expr("cast(array() as array<struct<a:int,rank:int,src:string,b:int,text:string>>)")

    def take(acc: Column, s: Column) -> Column:
        overlaps = lambda k: (s["a"] < k["b"]) & (k["a"] < s["b"])
        longer = F.exists(acc, lambda k: overlaps(k) & (k["rank"] <= s["rank"]))
        return F.when(longer, acc).otherwise(F.concat(F.filter(acc, lambda k: ~overlaps(k) | (k["rank"] < s["rank"])), F.array(s)))

    per = live.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(span)), empty, take).alias("kept"), F.any_value("heading_path").alias("heading_path"))
    kept = per.select(*keys, "heading_path", F.explode("kept").alias("k")).select(
        *keys, F.col("k.text").alias("text"), F.col("k.a").alias("start_char"), F.col("k.b").alias("end_char"), F.col("k.src").alias("source"), F.lit(None).cast("string").alias("skipped_reason"), "heading_path")
    both = kept.unionByName(mentions.where(F.col("skipped_reason").isNotNull()).select(*kept.columns))
    place = Window.partitionBy(*keys).orderBy("start_char", "end_char", F.col("skipped_reason").asc_nulls_first(), "source")
    return both.withColumn("m_ord", F.row_number().over(place) - 1)


def propose(sentences: DataFrame, gazetteer: DataFrame, capitals: bool = False, more: Iterable[DataFrame] = ()) -> DataFrame:
    """All proposers together, merged: listed names, markup cues and pronouns; optionally capitalised runs and others."""
    listed = listed_names(sentences, gazetteer)
    found = listed.unionByName(markdown_cues(sentences)).unionByName(pronouns(sentences))
    if capitals:
        found = found.unionByName(capital_runs(sentences, listed))
    for frame in more:
        found = found.unionByName(frame)
    return merge(found)


def suggest_names(sentences: DataFrame, gazetteer: DataFrame, most: int = 14) -> DataFrame:
    """(document_id, name, n, rank): the names most often written in capitals that are not listed yet.

    A single word seen only once, as a sentence's first, is no suggestion. ``most`` is the feature: a top list.
    """
    runs = capital_runs(masked(sentences, listed_names(sentences, gazetteer)))
    listed = gazetteer.select(F.lower("name").alias("listed")).distinct()
    opens = sentences.select("document_id", "sentence_id", F.col("start_char").alias("opens_at"))
    rows = runs.join(opens, ["document_id", "sentence_id"]).join(listed, F.lower("text") == F.col("listed"), "left_anti")
    opening = ((F.col("start_char") == F.col("opens_at")) & ~F.col("text").contains(" ")).cast("int")
    per = rows.groupBy("document_id", F.col("text").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(opening).alias("openings"))
    per = per.where(~((F.col("n") == 1) & (F.col("openings") == 1)))
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("n"), "name"))
    return per.withColumn("rank", rank).where(F.col("rank") <= most).select("document_id", "name", "n", "rank")


def occurrences(hay: Column, needle: Column) -> Column:
    """array<int> of where a needle occurs as whole words, overlaps included, any case where that keeps places (0-based)."""
    same = (F.length(F.lower(hay)) == F.length(hay)) & (F.length(F.lower(needle)) == F.length(needle))
    h, n = F.when(same, F.lower(hay)).otherwise(hay), F.when(same, F.lower(needle)).otherwise(needle)
    letter = r"[\p{L}\p{N}]"
    quoted = F.concat(F.lit(f"(?<!{letter})(?=\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?!{letter}))"))
    found = F.transform(found_at(h, quoted), lambda x: x["at"])
    return F.when((n != "") & F.contains(h, n), found).otherwise(F.expr("cast(array() as array<int>)"))


def attach_spans(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, ord, name, start_char, end_char): each name on its first free occurrence that overlaps none before it.

    A name without one gets -1 - ord for both ends, so that it counts as found nowhere.
    """
    joined = named.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "ord", "name", occurrences(F.col("text"), F.col("name")).alias("at"))
    item = F.struct("ord", "name", "at")
    per = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def place(acc: Column, x: Column) -> Column:
        size = F.length(x["name"])
        free = F.filter(x["at"], lambda i: ~F.exists(acc, lambda k: (i < k["b"]) & (k["a"] < i + size)))
        a = F.when(F.size(free) > 0, F.element_at(free, 1)).otherwise(-1 - x["ord"]).cast("int")
        b = F.when(F.size(free) > 0, F.element_at(free, 1) + size).otherwise(-1 - x["ord"]).cast("int")
        return F.concat(acc, F.array(F.struct(x["ord"].cast("int").alias("ord"), x["name"].alias("name"), a.alias("a"), b.alias("b"))))

    placed = F.aggregate("items", F.expr("cast(array() as array<struct<ord:int,name:string,a:int,b:int>>)"), place)
    return per.select("doc_id", F.explode(placed).alias("p")).select("doc_id", "p.ord", "p.name", F.col("p.a").alias("start_char"), F.col("p.b").alias("end_char"))
