"""Decisions to a graph: entities, relationships, review and rejected items; audit, lineage and statistics.

"First" always means the least explicit order column, so results do not depend on how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_name
from .decide import ACCEPT, REJECT, REVIEW
from .ontology import NO_RELATION, NOT_ENTITY, Ontology

SPAN_TEXT_CHARS = 500
ITEM = "document_id string, queue string, kind string, reason string, text string, source string, target string, type string, asked string, band string, prob double, span_start int, span_end int, sentence_id string"


def route_mentions(typed: DataFrame) -> DataFrame:
    """typed with name (canonical), route ('entity', 'review' or 'rejected') and reason."""
    rows = typed.withColumn("name", canonical_name(F.col("text")))
    route = (
        F.when(F.col("band") == REVIEW, "review")
        .when((F.col("band") == REJECT) | (F.col("entity_type") == NOT_ENTITY), "rejected")
        .when(F.coalesce(F.col("name"), F.lit("")) == "", "rejected")
        .otherwise("entity")
    )
    opaque = (F.col("band") == ACCEPT) & (F.col("entity_type") != NOT_ENTITY) & (F.coalesce(F.col("name"), F.lit("")) == "")
    return rows.withColumn("route", route).withColumn("reason", F.when(opaque, "opaque_or_empty_name"))


def merge_entities(routed: DataFrame, order: str = "d_ord") -> DataFrame:
    """One row per document and canonical name: first kind and surface, greatest probability, all surfaces in order."""
    rows = routed.where(F.col("route") == "entity")
    surfaces = rows.groupBy("document_id", "name", "text").agg(F.min(order).alias("at"), F.max("winner_prob").alias("p"), F.min_by("entity_type", order).alias("kind"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "; ")
    out = surfaces.groupBy("document_id", "name").agg(
        F.min_by("kind", "at").alias("entity_type"), F.min_by("text", "at").alias("display_name"), F.max("p").alias("importance"), F.substring(ordered, 1, SPAN_TEXT_CHARS).alias("source_spans"))
    return out.select("document_id", "name", "entity_type", "display_name", "importance", "source_spans", F.concat("document_id", F.lit("-chunk-0")).alias("source_chunk_id"))


def route_links(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """hits with canonical source and target, route ('edge', 'review', 'rejected' or 'none') and reason.

    Both ends have to be entities of the document. Accepted links between one name, or with a nameless end,
    are rejected.
    """
    rows = hits.withColumn("source", canonical_name(F.col("src_text"))).withColumn("target", canonical_name(F.col("tgt_text")))
    known = entities.select("document_id", F.col("name").alias("known"))
    rows = rows.join(known.withColumnRenamed("known", "source").withColumn("source_known", F.lit(True)), ["document_id", "source"], "left")
    rows = rows.join(known.withColumnRenamed("known", "target").withColumn("target_known", F.lit(True)), ["document_id", "target"], "left")
    bad = (F.coalesce("source", F.lit("")) == "") | (F.coalesce("target", F.lit("")) == "") | (F.col("source") == F.col("target"))
    accepted = (F.col("band") == ACCEPT) & (F.col("relation_type") != NO_RELATION)
    reason = F.when(accepted & bad, "bad_endpoints").when(accepted & (F.col("source_known").isNull() | F.col("target_known").isNull()), "endpoint_not_accepted")
    route = F.when(F.col("band") == REVIEW, "review").when(~accepted, "rejected").when(reason == "bad_endpoints", "rejected").when(reason.isNotNull(), "review").otherwise("edge")
    return rows.withColumn("reason", reason).withColumn("route", route).drop("source_known", "target_known")


def merge_links(routed: DataFrame) -> DataFrame:
    """One row per source, target and relation: the first hit's weight and evidence."""
    first = F.row_number().over(Window.partitionBy("document_id", "source", "target", "relation_type").orderBy("h_ord"))
    rows = routed.where(F.col("route") == "edge").withColumn("rn", first).where(F.col("rn") == 1)
    return rows.select("document_id", "source", "target", "relation_type", F.col("prob").alias("weight"), F.col("evidence").alias("description"), "h_ord", "sentence_id")


def queue(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Review and rejected items of both kinds as one table (``ITEM``)."""
    none = F.lit(None).cast("string")
    m = mentions.where(F.col("route").isin("review", "rejected")).select(
        "document_id", F.col("route").alias("queue"), F.lit("entity").alias("kind"), "reason", "text", none.alias("source"), none.alias("target"), F.col("entity_type").alias("type"), none.alias("asked"),
        "band", F.col("winner_prob").alias("prob"), F.col("start_char").alias("span_start"), F.col("end_char").alias("span_end"), "sentence_id")
    r = links.where(F.col("route").isin("review", "rejected")).select(
        "document_id", F.col("route").alias("queue"), F.lit("relation").alias("kind"), "reason", none.alias("text"), F.col("src_text").alias("source"), F.col("tgt_text").alias("target"), F.col("relation_type").alias("type"),
        "asked", "band", "prob", F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_end"), "sentence_id")
    return m.unionByName(r)


def in_document_order(typed: DataFrame, sentences: DataFrame) -> DataFrame:
    """typed with d_ord, the place among all typed mentions of the document."""
    idx = sentences.select("document_id", "sentence_id", "idx")
    order = Window.partitionBy("document_id").orderBy("idx", "t_ord")
    return typed.join(idx, ["document_id", "sentence_id"]).withColumn("d_ord", F.row_number().over(order) - 1).drop("idx")


def audit(entities: DataFrame, relationships: DataFrame, sentences: DataFrame, ontology: Ontology) -> DataFrame:
    """(document_id, rule, subject) of every broken invariant of a graph; empty for a sound one."""
    kinds = [k.id for k in ontology.kinds]
    links = [x.id for x in ontology.links]
    label = F.concat_ws(" ", "source", "relation_type", "target")

    def broken(rows: DataFrame, rule: str, subject: Column, wrong: Column) -> DataFrame:
        return rows.where(wrong).select("document_id", F.lit(rule).alias("rule"), subject.alias("subject"))

    found = broken(entities, "kind is listed", F.col("name"), ~F.col("entity_type").isin(*kinds))
    found = found.unionByName(broken(entities, "entity has evidence", F.col("name"), F.coalesce("source_spans", F.lit("")) == ""))
    found = found.unionByName(broken(entities, "importance within 0 and 1", F.col("name"), ~F.coalesce(F.col("importance").between(0, 1), F.lit(False))))
    found = found.unionByName(broken(relationships, "link is listed", label, ~F.col("relation_type").isin(*links)))
    found = found.unionByName(broken(relationships, "no link to itself", label, F.col("source") == F.col("target")))
    found = found.unionByName(broken(relationships, "weight within 0 and 1", label, ~F.coalesce(F.col("weight").between(0, 1), F.lit(False))))
    ends = relationships.select("document_id", label.alias("subject"), F.explode(F.array("source", "target")).alias("name"))
    found = found.unionByName(ends.join(entities.select("document_id", "name"), ["document_id", "name"], "left_anti").select("document_id", F.lit("both ends are entities").alias("rule"), "subject"))
    stated = relationships.select("document_id", label.alias("subject"), F.col("description").alias("text"))
    found = found.unionByName(stated.join(sentences.select("document_id", "text"), ["document_id", "text"], "left_anti").select("document_id", F.lit("evidence is a sentence").alias("rule"), "subject"))
    legal = ontology.signature_table(entities.sparkSession)
    kind_of = lambda p: entities.select("document_id", F.col("name").alias(p), F.col("entity_type").alias(f"{'src' if p == 'source' else 'tgt'}_type"))
    typed = relationships.join(kind_of("source"), ["document_id", "source"]).join(kind_of("target"), ["document_id", "target"]).withColumnRenamed("relation_type", "relation")
    illegal = typed.join(F.broadcast(legal.select("src_type", "tgt_type", "relation")), ["src_type", "tgt_type", "relation"], "left_anti")
    return found.unionByName(illegal.select("document_id", F.lit("signature is legal").alias("rule"), F.concat_ws(" ", "source", "relation", "target").alias("subject"))).distinct()


def lineage(typed: DataFrame, hits: DataFrame) -> DataFrame:
    """Accepted decisions with who made them."""
    m = typed.where((F.col("band") == ACCEPT) & (F.col("entity_type") != NOT_ENTITY)).select("document_id", "sentence_id", F.lit("entity").alias("what"), F.col("text").alias("subject"), F.col("entity_type").alias("decision"), "decided_by", F.col("winner_prob").alias("prob"))
    r = hits.where(F.col("band") == ACCEPT).select("document_id", "sentence_id", F.lit("relation").alias("what"), F.concat_ws(" -> ", "src_text", "tgt_text").alias("subject"), F.col("relation_type").alias("decision"), F.lit("model").alias("decided_by"), "prob")
    return m.unionByName(r)


def run_statistics(sentences: DataFrame, mentions: DataFrame, typed: DataFrame, hits: DataFrame, cut: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row of counters per document."""
    count = lambda rows, name, wrong=F.lit(True): rows.groupBy("document_id").agg(F.sum(wrong.cast("long")).alias(name))
    parts = [
        count(mentions, "mentions_proposed"), count(mentions, "mentions_skipped", F.col("skipped_reason").isNotNull()), count(typed, "mentions_typed"),
        count(typed, "mentions_accepted", (F.col("band") == ACCEPT) & (F.col("entity_type") != NOT_ENTITY)), count(hits, "predicates_asked"), count(hits, "links_accepted", F.col("band") == ACCEPT),
        cut.groupBy("document_id").agg(F.sum("pairs_cut").alias("pairs_truncated")), count(entities, "entities"), count(relationships, "relationships")]
    out = count(sentences, "sentences")
    for part in parts:
        out = out.join(part, "document_id", "left")
    return out.na.fill(0)
