"""Graphs to statements, payloads, pages and summaries."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escaped, json_quoted, link_phrase, pretty_name, pretty_type, review_phrase
from .ontology import NOT_ENTITY, UNKNOWN_COLOR, Ontology

GRAPH_NODES, KEPT_WEIGHT, PENDING_WEIGHT, PENDING_NODE = 80, 1.0, 0.4, 0.5
LINK_ROWS, CARD_ROWS, DROPPED_ROWS = 200, 100, 200
PENDING_COLOR = "#fbbf24"


def cypher(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(document_id, ord, statement): a MERGE for each entity, then one for each edge."""
    nodes = entities.select(
        "document_id", F.lit(0).alias("ord"),
        F.concat(F.lit("MERGE (n:Node {id: "), json_quoted(F.col("name")), F.lit("}) SET n.entity_type = "), json_quoted(F.col("entity_type")), F.lit(", n.description = "), json_quoted(F.col("display_name")), F.lit(";")).alias("statement"))
    edges = relationships.select(
        "document_id", F.lit(1).alias("ord"),
        F.concat(F.lit("MATCH (a:Node {id: "), json_quoted(F.col("source")), F.lit("}), (b:Node {id: "), json_quoted(F.col("target")), F.lit("}) MERGE (a)-[e:EDGE {relation_type: "), json_quoted(F.col("relation_type")),
                 F.lit("}]->(b) SET e.description = "), json_quoted(F.col("description")), F.lit(";")).alias("statement"))
    return nodes.unionByName(edges)


def graph_nodes(entities: DataFrame, ontology: Ontology) -> DataFrame:
    kinds = F.broadcast(ontology.kind_table(entities.sparkSession).select(F.col("id").alias("entity_type"), F.col("color").alias("listed_color")))
    rows = entities.join(kinds, "entity_type", "left")
    return rows.select("document_id", F.col("name").alias("id"), F.coalesce("display_name", pretty_name(F.col("name"))).alias("label"), F.col("entity_type").alias("type"), pretty_type(F.col("entity_type")).alias("kind"), F.coalesce("listed_color", F.lit(UNKNOWN_COLOR)).alias("color"))


def graph_edges(entities: DataFrame, relationships: DataFrame, items: DataFrame) -> DataFrame:
    """Kept edges with their sentence, and those under review; ends of the latter by surface where they are no entity."""
    label = lambda p: entities.select("document_id", F.col("name").alias(p), F.coalesce("display_name", pretty_name(F.col("name"))).alias(f"{p}_label"))
    kept = relationships.join(label("source"), ["document_id", "source"], "left").join(label("target"), ["document_id", "target"], "left")
    sentence = link_phrase(F.coalesce("source_label", "source"), F.col("relation_type"), F.coalesce("target_label", "target"))
    kept = kept.select("document_id", "source", "target", F.col("relation_type").alias("type"), pretty_type(F.col("relation_type")).alias("label"), sentence.alias("sentence"), F.col("description").alias("evidence"), F.lit(False).alias("review"))
    review = items.where((F.col("queue") == "review") & (F.col("kind") == "relation") & (F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    ask = review_phrase(F.col("kind"), F.col("text"), F.col("type"), F.col("source"), F.col("target"), F.col("prob"))
    review = review.select("document_id", "source", "target", F.coalesce("type", F.lit("NONE")).alias("type"), pretty_type(F.col("type")).alias("label"), ask.alias("sentence"), F.lit("").alias("evidence"), F.lit(True).alias("review"))
    return kept.unionByName(review)


def web_graph(entities: DataFrame, relationships: DataFrame, items: DataFrame, sentences: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the page: ghost edges between kept names, and unsure names as pending nodes."""
    kept = graph_nodes(entities, ontology).select("document_id", "id", "label", "type", "color", F.lit(False).alias("pending"))
    unsure = items.where((F.col("queue") == "review") & (F.col("kind") == "entity") & (F.coalesce("text", F.lit("")) != ""))
    unsure = unsure.select("document_id", F.regexp_replace(F.upper("text"), r"\s+", "_").alias("id"), F.col("text").alias("label"), F.when(F.col("type") != NOT_ENTITY, F.col("type")).otherwise("unsure").alias("type"), "span_start")
    unsure = unsure.groupBy("document_id", "id").agg(F.min_by("label", "span_start").alias("label"), F.min_by("type", "span_start").alias("type"))
    unsure = unsure.join(kept.select("document_id", "id"), ["document_id", "id"], "left_anti").select("document_id", "id", "label", "type", F.lit(PENDING_COLOR).alias("color"), F.lit(True).alias("pending"))
    edges = relationships.select("document_id", "source", "target", F.col("relation_type").alias("relation"), "weight", F.col("description").alias("evidence"), F.lit(False).alias("pending"))
    by_label = lambda p: entities.select("document_id", F.lower(F.coalesce("display_name", "name")).alias(f"{p}_key"), F.col("name").alias(f"{p}_id"))
    ghosts = items.where((F.col("queue") == "review") & (F.col("kind") == "relation") & F.col("asked").isNotNull())
    ghosts = ghosts.withColumn("s_key", F.lower("source")).withColumn("t_key", F.lower("target")).join(by_label("s"), ["document_id", "s_key"]).join(by_label("t"), ["document_id", "t_key"])
    texts = sentences.select("document_id", "sentence_id", F.col("text").alias("evidence"))
    ghosts = ghosts.drop("text").join(texts, ["document_id", "sentence_id"], "left")
    ghosts = ghosts.select("document_id", F.col("s_id").alias("source"), F.col("t_id").alias("target"), F.col("asked").alias("relation"), F.col("prob").alias("weight"), "evidence", F.lit(True).alias("pending"))
    return kept.unionByName(unsure), edges.unionByName(ghosts)


def cap_graph(nodes: DataFrame, edges: DataFrame, most: int = GRAPH_NODES) -> tuple[DataFrame, DataFrame]:
    """The ``most`` best linked nodes of each document and the edges between them: a top list is the feature."""
    weight = F.when(F.col("pending"), PENDING_WEIGHT).otherwise(KEPT_WEIGHT)
    degree = edges.select("document_id", weight.alias("w"), F.explode(F.array("source", "target")).alias("id")).groupBy("document_id", "id").agg(F.sum("w").alias("degree"))
    ranked = nodes.join(degree, ["document_id", "id"], "left").withColumn("degree", F.round(F.coalesce("degree", F.lit(0.0)) - F.when(F.col("pending"), PENDING_NODE).otherwise(0.0), 6))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("degree"), "label", "id"))
    kept = ranked.withColumn("place", place).where(F.col("place") <= most)
    ids = kept.select("document_id", "id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), ["document_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["document_id", "target"], "left_semi")
    return kept, inside


def highlight(text: Column, spans: Column) -> Column:
    """A text as HTML with its spans (array<struct<start, end, title, color>>) marked: the longest of those that begin together, no overlaps."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("rank"), s["end"].alias("b"), s["title"].alias("title"), s["color"].alias("color"))))
    mark = lambda s: F.concat(F.lit('<mark style="background:'), html_escaped(s["color"]), F.lit('" title="'), html_escaped(s["title"]), F.lit('">'), html_escaped(text.substr(s["a"] + 1, s["b"] - s["a"])), F.lit("</mark>"))
    state = F.aggregate(
        ranked, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["a"] < acc["at"], acc).otherwise(F.struct(s["b"].cast("int").alias("at"), F.concat(acc["out"], html_escaped(text.substr(acc["at"] + 1, s["a"] - acc["at"])), mark(s)).alias("out"))))
    return F.concat(state["out"], html_escaped(text.substr(state["at"] + 1, F.length(text))))


def marks(typed: DataFrame, most: int | None = None) -> DataFrame:
    """Mentions that the page marks: by place, those overlapping an earlier one left out, with their class."""
    cls = F.when((F.col("band") == "ACCEPT") & (F.col("entity_type") != NOT_ENTITY), "kept").when(F.col("band") == "REVIEW", "unsure").otherwise("dropped")
    span = F.struct(F.col("start_char").alias("a"), F.col("end_char").alias("b"), cls.alias("cls"), F.col("text").alias("text"))
    per = typed.groupBy("document_id", "sentence_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    kept = F.aggregate("spans", F.expr("cast(array() as array<struct<a:int,b:int,cls:string,text:string>>)"),
                       lambda acc, s: F.when((F.size(acc) > 0) & (s["a"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["b"], F.lit(0))), acc).otherwise(F.concat(acc, F.array(s))))
    return per.select("document_id", "sentence_id", F.explode(kept).alias("s")).select("document_id", "sentence_id", F.col("s.a").alias("start_char"), F.col("s.b").alias("end_char"), F.col("s.cls").alias("css_class"), F.col("s.text").alias("text"))


def listing(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each document's list and how many more there are: the page's cut lists."""
    w = Window.partitionBy("document_id")
    numbered = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - most))
    return numbered.where(F.col("place") <= most)


def dashboard(entities: DataFrame, relationships: DataFrame, items: DataFrame) -> DataFrame:
    """(document_id, names_kept, links_kept, in_review, names_dropped, links_dropped)."""
    n = lambda rows, name: rows.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    parts = [n(relationships, "links_kept"), n(items.where(F.col("queue") == "review"), "in_review"), n(items.where((F.col("queue") == "rejected") & (F.col("kind") == "entity")), "names_dropped"), n(items.where((F.col("queue") == "rejected") & (F.col("kind") == "relation")), "links_dropped")]
    out = n(entities, "names_kept")
    for p in parts:
        out = out.join(p, "document_id", "full_outer")
    return out.na.fill(0)


def result_json(entities: DataFrame, relationships: DataFrame, items: DataFrame, mentions: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """(document_id, result_json): entities, relationships, review and rejected items, mentions and metadata of each document as one JSON text.

    ``metadata`` has document_id and further columns. Entities stand by name, relationships in the order of their hits.
    """
    per = lambda rows, name, *cols: rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    item = ("span_start", "kind", "reason", "text", "source", "target", "type", "asked", "band", "prob", "sentence_id")
    parts = [
        per(entities, "entities", "name", "entity_type", "display_name", "importance", "source_spans"), per(relationships, "relationships", *(["h_ord"] if "h_ord" in relationships.columns else []), "source", "target", "relation_type", "weight", "description"),
        per(items.where(F.col("queue") == "review"), "review", *item), per(items.where(F.col("queue") == "rejected"), "rejected", *item)]
    if mentions is not None:
        parts.append(per(mentions, "mentions", "start_char", "end_char", "text", "source", "skipped_reason", "sentence_id"))
    if metadata is not None:
        parts.append(metadata.select("document_id", F.struct(*[c for c in metadata.columns if c != "document_id"]).alias("metadata")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "document_id", "full_outer")
    names = [c for c in out.columns if c != "document_id"]
    filled = [F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) if c != "metadata" else F.col(c) for c in names]
    return out.select("document_id", F.to_json(F.struct(*filled)).alias("result_json"))


EXPORTED = ("entities", "relationships", "review", "metadata")


def exportable(results: DataFrame) -> DataFrame:
    """(document_id, result_json) with what may leave the page: entities, relationships, review and metadata."""
    parsed = F.parse_json("result_json")
    part = lambda c: F.to_json(F.try_variant_get(parsed, f"$.{c}", "variant"))
    fields = [F.when(part(c).isNotNull(), F.concat(F.lit(f'"{c}":'), part(c))) for c in EXPORTED]
    return results.select("document_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("result_json"))


# pages


def _table(rows: DataFrame, name: str, head: list[str], cells: list[Column], order: list) -> DataFrame:
    """(document_id, name): the rows of each document as an HTML table, the first ``LINK_ROWS`` and how many more there are."""
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    kept = listing(rows.withColumn("_row", row), order, LINK_ROWS)
    per = kept.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "_row"))).alias("r"), F.max("more").alias("more"))
    top = "".join(f"<th>{html.escape(h)}</th>" for h in head)
    more = F.when(F.col("more") > 0, F.format_string("<p>and %d more</p>", F.col("more"))).otherwise("")
    return per.select("document_id", F.concat(F.lit(f"<table><tr>{top}</tr>"), F.array_join(F.transform("r", lambda x: x["_row"]), ""), F.lit("</table>"), more).alias(name))


def report_pages(docs: DataFrame, typed: DataFrame, entities: DataFrame, relationships: DataFrame, items: DataFrame, ontology: Ontology, title: str = "Report") -> DataFrame:
    """(document_id, page): a self-contained page for each document with its counts, a legend, the highlighted text and tables of names, links and what waits for review.

    Every page is made where its rows are; nothing is gathered.
    """
    kinds = F.broadcast(ontology.kind_table(docs.sparkSession).select(F.col("id").alias("entity_type"), F.col("color").alias("listed_color")))
    shown = typed.where((F.col("band") == "ACCEPT") & (F.col("entity_type") != NOT_ENTITY)).join(kinds, "entity_type", "left")
    span = F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.col("entity_type").alias("title"), F.coalesce("listed_color", F.lit(UNKNOWN_COLOR)).alias("color"))
    spans = shown.groupBy("document_id").agg(F.collect_list(span).alias("spans"))
    phrase = link_phrase(F.col("source"), F.col("relation_type"), F.col("target"))
    review = items.where(F.col("queue") == "review")
    ask = review_phrase(F.col("kind"), F.col("text"), F.col("type"), F.col("source"), F.col("target"), F.col("prob"))
    parts = [
        spans, dashboard(entities, relationships, items),
        _table(entities, "names", ["name", "kind", "written", "importance"], [F.col("display_name"), pretty_type(F.col("entity_type")), F.col("source_spans"), F.round("importance", 3)], ["name"]),
        _table(relationships, "links", ["link", "sentence", "weight"], [phrase, F.col("description"), F.round("weight", 3)], ["h_ord"]),
        _table(review, "waiting", ["question", "sentence"], [ask, F.col("sentence_id")], ["sentence_id", "kind", "span_start", "asked"])]
    rows = docs.select("document_id", F.coalesce("text", F.lit("")).alias("text"))
    for part in parts:
        rows = rows.join(part, "document_id", "left")
    legend = "".join(f'<li><mark style="background:{html.escape(k.color)}">{html.escape(k.id.lower().replace("_", " "))}</mark></li>' for k in ontology.kinds)
    stats = F.format_string("%d names, %d links, %d to review, %d names and %d links dropped", *[F.coalesce(c, F.lit(0)) for c in ("names_kept", "links_kept", "in_review", "names_dropped", "links_dropped")])
    text = highlight(F.col("text"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int,title:string,color:string>>)")))
    section = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<h2>{head}</h2>"), F.col(c))).otherwise("")
    page = F.concat(
        F.lit(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}: "), html_escaped(F.col("document_id")), F.lit("</h1><p>"), stats, F.lit(f"</p><ul>{legend}</ul><pre style='white-space:pre-wrap'>"), text,
        F.lit("</pre>"), section("Names", "names"), section("Links", "links"), section("To review", "waiting"))
    return rows.select("document_id", page.alias("page"))


def graph_pages(nodes: DataFrame, edges: DataFrame, title: str = "Graph") -> DataFrame:
    """(document_id, page): a self-contained page of each (capped) graph; script ends in texts cannot leave the data block."""
    n = nodes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "label", "type", "color", "pending"))).alias("nodes"))
    e = edges.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "relation", "weight", "evidence", "pending"))).alias("edges"))
    rows = n.join(e, "document_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)))
    data = F.replace(F.to_json(F.struct("nodes", "edges")), F.lit("</"), F.lit("<\\/"))
    table = F.array_join(F.transform("edges", lambda x: F.concat(F.lit("<tr><td>"), html_escaped(x["source"]), F.lit("</td><td>"), html_escaped(x["relation"]), F.lit("</td><td>"), html_escaped(x["target"]), F.lit("</td></tr>"))), "")
    legend = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("nodes", lambda x: F.struct(x["type"].alias("t"), x["color"].alias("c"))))), lambda x: F.concat(F.lit('<li style="color:'), html_escaped(x["c"]), F.lit('">'), html_escaped(x["t"]), F.lit("</li>"))), "")
    page = F.concat(
        F.lit(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>"), F.format_string("%d names, %d links", F.size("nodes"), F.size("edges")), F.lit("</p><ul>"), legend,
        F.lit("</ul><table>"), table, F.lit("</table><script type=application/json id=graph>"), data, F.lit("</script>"))
    return rows.select("document_id", page.alias("page"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """One file for each document, written by the tasks that have it into a folder that all of them share."""

    def write(rows) -> None:
        import os
        import re

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            name = re.sub(r"[^\w.-]", "_", r.document_id) or "_"
            with open(os.path.join(folder, f"{name}.html"), "w", encoding="utf-8") as f:
                f.write(r.page)

    pages.foreachPartition(write)
