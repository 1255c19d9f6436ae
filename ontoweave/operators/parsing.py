"""Documents to lines, headings, paragraphs, sentences, block units, bounded pieces and token spans.

Everything is windows and aggregates over exploded lines, hash-partitioned by document once: the later
steps group by keys that begin with document_id and so reuse that partitioning. Offsets are code points,
half-open, and slice the original text. A null text counts as an empty one and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ABBREVIATIONS, WS, lead, strip
from ..session import over_rows, spread
from .ontology import Ontology

FRONT_MATTER = r"(?s)\A---\r?\n.*?\r?\n---\r?\n"
HEADING = r"^(#{1,6})\s+(.*)$"
BLOCK = r"^\s*(?:[-*+]\s|\||>|\d+[.)]\s)"
SENTENCE_END = rf"(?<!(?:^|[^\p{{L}}])(?i:{'|'.join(ABBREVIATIONS)}))[.!?][.!?\"')]*+(?={WS}+|\z)"
CUT = "\u0001"


def front_matter_length(text: Column) -> Column:
    """How many characters of leading front matter a text has."""
    return F.length(F.regexp_extract(F.coalesce(text, F.lit("")), FRONT_MATTER, 0))


def strip_front_matter(docs: DataFrame) -> DataFrame:
    """(document_id, body, body_start)."""
    n = front_matter_length(F.col("text"))
    return docs.select("document_id", F.expr("text").alias("t"), n.alias("body_start")).select(
        "document_id", F.col("t").substr(F.col("body_start") + 1, F.greatest(F.length("t"), F.lit(1))).alias("body"), "body_start"
    )


def lines(docs: DataFrame) -> DataFrame:
    """(document_id, line_no, line, line_start): the body's lines without their line feeds, offsets into the text."""
    body = strip_front_matter(docs).where(F.col("body") != "")
    rows = body.select("document_id", "body_start", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    before = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("body_start") + F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    return rows.select("document_id", "line_no", "line", start.cast("int").alias("line_start"))


def marked_lines(docs: DataFrame) -> DataFrame:
    """Lines with in_fence, level and title of headings, and the heading path that holds for them."""
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = lines(docs).withColumn("is_fence", F.col("line").startswith("```"))
    rows = rows.withColumn("fences", F.sum(F.col("is_fence").cast("int")).over(order))
    rows = rows.withColumn("in_fence", F.col("is_fence") | (F.col("fences") % 2 == 1))
    is_heading = ~F.col("in_fence") & F.col("line").rlike(HEADING)
    rows = rows.withColumn("level", F.when(is_heading, F.length(F.regexp_extract("line", HEADING, 1))))
    rows = rows.withColumn("title", F.when(is_heading, strip(F.regexp_extract("line", HEADING, 2))))
    # a heading of level L is in force until one of level L or less follows
    for at in range(1, 7):
        held = F.when(F.col("level") == at, F.struct("line_no", "title"))
        rows = rows.withColumn(f"h{at}", F.last(held, ignorenulls=True).over(order))
    steps = []
    for at in range(1, 7):
        above = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{k}.line_no"), F.lit(-1)) for k in range(1, at)])
        steps.append(F.when(F.col(f"h{at}.line_no") > above, F.col(f"h{at}.title")))
    path = F.filter(F.array(*steps), lambda t: t.isNotNull())
    return rows.select("document_id", "line_no", "line", "line_start", "is_fence", "in_fence", "level", "title", path.alias("heading_path"))


def fence_regions(docs: DataFrame) -> DataFrame:
    """(document_id, start_char, end_char): fenced blocks, an unclosed one runs to the end of the text."""
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = marked_lines(docs).withColumn("opens", F.col("is_fence") & (F.row_number().over(Window.partitionBy("document_id", "is_fence").orderBy("line_no")) % 2 == 1))
    rows = rows.withColumn("region", F.sum(F.col("opens").cast("int")).over(order)).where(F.col("in_fence"))
    return rows.groupBy("document_id", "region").agg(F.min("line_start").alias("start_char"), F.max(F.col("line_start") + F.length("line")).alias("end_char")).drop("region")


def headings(docs: DataFrame) -> DataFrame:
    """(document_id, line_no, level, title, heading_path) of every heading; its own title ends its path."""
    return marked_lines(docs).where(F.col("level").isNotNull()).select("document_id", "line_no", "level", "title", "heading_path")


def paragraphs(docs: DataFrame, blocks: bool = False) -> DataFrame:
    """(document_id, para_no, start_char, chunk, heading_path).

    Blank lines, headings and fences end a paragraph; with ``blocks`` every list item, table row and
    quoted line starts one of its own.
    """
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = marked_lines(docs)
    breaks = F.col("in_fence") | F.col("level").isNotNull() | (strip(F.col("line")) == "")
    starts = breaks | F.col("line").rlike(BLOCK) if blocks else breaks
    rows = rows.withColumn("breaks", breaks).withColumn("para", F.sum(starts.cast("int")).over(order)).where(~F.col("breaks"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    grouped = rows.groupBy("document_id", "para").agg(F.min("line_start").alias("start_char"), text.alias("chunk"), F.min_by("heading_path", "line_no").alias("heading_path"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("para")) - 1
    return grouped.select("document_id", number.alias("para_no"), "start_char", "chunk", "heading_path")


def sentences(docs: DataFrame, blocks: bool = False, max_chars: int | None = None) -> DataFrame:
    """(document_id, sentence_id, idx, text, start_char, end_char, heading_path), true offsets."""
    paras = paragraphs(docs, blocks)
    marked = F.regexp_replace("chunk", SENTENCE_END, f"$0{CUT}")
    pieces = paras.select("document_id", "para_no", "start_char", "heading_path", F.posexplode(F.split(marked, CUT)).alias("piece_no", "piece"))
    before = Window.partitionBy("document_id", "para_no").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start_char") + F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + lead(F.col("piece"))
    rows = pieces.select("document_id", "para_no", "piece_no", "heading_path", strip(F.col("piece")).alias("text"), at.cast("int").alias("start_char")).where(F.col("text") != "")
    if max_chars:
        rows = _bounded(rows, max_chars)
    else:
        rows = rows.withColumn("part_no", F.lit(0))
    idx = F.row_number().over(Window.partitionBy("document_id").orderBy("para_no", "piece_no", "part_no")) - 1
    rows = rows.withColumn("idx", idx)
    return rows.select(
        "document_id", F.concat("document_id", F.lit("-s"), F.col("idx").cast("string")).alias("sentence_id"), "idx", "text", "start_char",
        (F.col("start_char") + F.length("text")).alias("end_char"), "heading_path")


def cut_ranges(text: str, most: int) -> list[tuple[int, int]]:
    """Half-open ranges of at most ``most`` characters that cover the text, cut where it breaks best.

    Best is a line end, then ``;`` or ``|``, then ``,`` or ``:``, then a blank, in the second half of
    the room; without any of these the cut is at the limit.
    """
    out, at = [], 0
    while len(text) - at > most:
        room = text[at : at + most]
        cut = most
        for signs in ("\n", ";|", ",:", " "):
            best = max(room.rfind(s) for s in signs)
            if best + 1 > most // 2:
                cut = best + 1
                break
        out.append((at, at + cut))
        at += cut
    if at < len(text):
        out.append((at, len(text)))
    return out


def bounded_pieces(df: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, part_no, start_char, end_char, part): every part within ``most`` characters, nothing lost."""

    def rows(c: dict[str, list]) -> Iterable[tuple]:
        for key, text in zip(c["key"], c["text"]):
            for no, (s, e) in enumerate(cut_ranges(text or "", most)):
                yield key, no, s, e, text[s:e]

    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = over_rows(spread(keyed), f"key {kind}, part_no int, start_char int, end_char int, part string", rows)
    return out.withColumnRenamed("key", id_col)


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """Sentences above the limit are cut; the rest never leave the JVM."""
    short = rows.where(F.length("text") <= most).withColumn("part_no", F.lit(0))
    long = rows.where(F.length("text") > most)

    def cut(c: dict[str, list]) -> Iterable[tuple]:
        for doc, para, piece, path, text, start in zip(*(c[k] for k in ("document_id", "para_no", "piece_no", "heading_path", "text", "start_char"))):
            for no, (s, e) in enumerate(cut_ranges(text, most)):
                part = text[s:e]
                ahead = len(part) - len(part.lstrip())
                if part.strip():
                    yield doc, para, piece, path, part.strip(), start + s + ahead, no

    schema = "document_id string, para_no int, piece_no int, heading_path array<string>, text string, start_char int, part_no int"
    return short.select("document_id", "para_no", "piece_no", "heading_path", "text", "start_char", "part_no").unionByName(over_rows(long, schema, cut))


def heading_context(path: Column) -> Column:
    return F.array_join(path, " > ")


def token_spans(tokens: Column) -> Column:
    """array<struct<token, start, end>> of tokens joined by one blank."""
    # start of token i = characters before it + blanks before it; a prefix sum folded over the array
    step = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<token:string,start:int,end:int>>)").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t) + 1).cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.struct(t.alias("token"), acc["at"].cast("int").alias("start"), (acc["at"] + F.length(t)).cast("int").alias("end")))).alias("out"),
        ),
    )
    return step["out"]


def token_rows(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """The same as rows, by a running sum: for token lists of any length."""
    rows = df.select(id_col, F.posexplode(tokens_col).alias("token_no", "token"))
    before = Window.partitionBy(id_col).orderBy("token_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)).cast("int")
    return rows.select(id_col, "token_no", "token", start.alias("start_char"), (start + F.length("token")).alias("end_char"))


def convert_spans(docs: DataFrame, types: dict[str, str], relations: dict[str, str], ontology: Ontology | None = None) -> tuple[DataFrame, DataFrame]:
    """Token-span documents (doc_id, tokens, entities, relations) to character spans.

    Returns entities (doc_id, index, name, type, start_char, end_char, token_start, token_end) and
    relations (doc_id, rel_no, type, source, target, with both ends' offsets). A span outside the tokens or empty, and
    a relation whose ends are not among the entities, raise. With an ontology so do labels that it does not know, once
    mapped, and links between kinds that it does not allow; without one, labels without a mapping keep their own.
    """
    kinds, links = [k.id for k in ontology.kinds] if ontology else [], [x.id for x in ontology.links] if ontology else []

    def label(c: Column, mapping: dict[str, str], known: list[str], what: str) -> Column:
        out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in mapping.items() for x in p]), c), c) if mapping else c
        return F.when(out.isin(*known), out).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what} "), F.coalesce(c, F.lit("null")))).cast("string")) if known else out

    spanned = docs.select("doc_id", "tokens", token_spans(F.col("tokens")).alias("spans"), "entities", "relations")
    ents = spanned.select("doc_id", "tokens", "spans", F.posexplode("entities").alias("index", "e"))
    a, b = F.col("e.start"), F.col("e.end")
    fits = (a >= 0) & (a < b) & (b <= F.size("tokens"))
    where = F.format_string("bad token span %s to %s in %s", a.cast("string"), b.cast("string"), F.col("doc_id").cast("string"))
    start = F.when(F.coalesce(fits, F.lit(False)), F.try_element_at("spans", a + 1)["start"]).otherwise(F.raise_error(where).cast("int"))
    ents = ents.select(
        "doc_id", "index", F.array_join(F.slice("tokens", F.greatest(a, F.lit(0)) + 1, F.greatest(b - a, F.lit(0))), " ").alias("name"), label(F.col("e.type"), types, kinds, "kind").alias("type"),
        start.alias("start_char"), F.try_element_at("spans", F.greatest(b, F.lit(1)))["end"].alias("end_char"), a.alias("token_start"), b.alias("token_end"))
    rels = spanned.select("doc_id", F.posexplode("relations").alias("rel_no", "r")).select("doc_id", "rel_no", label(F.col("r.type"), relations, links, "link").alias("type"), F.col("r.head").alias("head"), F.col("r.tail").alias("tail"))
    side = lambda name: ents.select("doc_id", F.col("index").alias(name), F.col("name").alias(f"{name}_name"), F.col("type").alias(f"{name}_type"), F.col("start_char").alias(f"{name}_start"), F.col("end_char").alias(f"{name}_end"))
    joined = rels.join(side("head"), ["doc_id", "head"], "left").join(side("tail"), ["doc_id", "tail"], "left")
    source = F.when(F.col("head_name").isNull() | F.col("tail_name").isNull(), F.raise_error(F.lit("relation points at no entity"))).otherwise(F.col("head_name"))
    if ontology:
        legal = F.array(*[F.lit(f"{s}|{r}|{t}") for s, t, r, _ in ontology.signatures])
        asked = F.concat_ws("|", "head_type", "type", "tail_type")
        source = F.when(F.array_contains(legal, asked), source).otherwise(F.raise_error(F.concat(F.lit("no legal link: "), asked)).cast("string"))
    return ents, joined.select("doc_id", "rel_no", "type", source.alias("source"), F.col("tail_name").alias("target"), "head_start", "head_end", "tail_start", "tail_end", "head_type", "tail_type")
