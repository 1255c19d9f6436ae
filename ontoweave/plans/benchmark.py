"""Benchmarks: token-span splits by exact spans, and notes with gold labels by names, each extracted and scored."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, parsing
from ..operators.decide import Decider, Gate
from ..operators.ontology import Ontology
from .pipeline import Extraction, extract, extract_sentences


@dataclass(frozen=True)
class Scores:
    """Counts per document, their micro averages with the ratios, and how long it took."""

    documents: DataFrame
    summary: DataFrame
    seconds: float


def split_sentences(docs: DataFrame) -> DataFrame:
    """Every token document as one sentence."""
    text = F.array_join("tokens", " ")
    return docs.select(
        F.col("doc_id").alias("document_id"), F.concat("doc_id", F.lit("-s0")).alias("sentence_id"), F.lit(0).alias("idx"), text.alias("text"), F.lit(0).alias("start_char"), F.length(text).alias("end_char"),
        F.expr("cast(array() as array<string>)").alias("heading_path"))


def run_split(
    docs: DataFrame, ontology: Ontology, types: dict[str, str], relations: dict[str, str], more: Iterable[Callable[[DataFrame], DataFrame]] = (), gate: Gate = Gate(), decider: Decider | None = None,
    model: str = "rules", gazetteer: DataFrame | None = None, capitals: bool = False, limit: int | None = None,
) -> Scores:
    """Convert, extract and score a split by exact spans. ``more`` are proposers such as an encoder; ``limit`` takes the first documents by id."""
    began = time.monotonic()
    if limit is not None:
        docs = docs.orderBy("doc_id").limit(limit)
    gold, links = parsing.convert_spans(docs, types, relations, ontology)
    x = extract_sentences(split_sentences(docs), ontology, gazetteer, gate, capitals, decider=decider, model=model, more=more)
    accepted = x.typed.where((F.col("band") == "ACCEPT") & F.col("entity_type").isin(*[k.id for k in ontology.kinds]))
    hits = x.hits.where(F.col("band") == "ACCEPT")
    per = evaluate.span_scores(
        accepted.select(F.col("document_id").alias("doc_id"), "start_char", "end_char", F.col("entity_type").alias("type")), gold.select("doc_id", "start_char", "end_char", "type"),
        hits.select(F.col("document_id").alias("doc_id"), "src_start", "src_end", "tgt_start", "tgt_end", F.col("relation_type").alias("type")),
        links.select("doc_id", F.col("head_start").alias("src_start"), F.col("head_end").alias("src_end"), F.col("tail_start").alias("tgt_start"), F.col("tail_end").alias("tgt_end"), "type"))
    per = docs.select("doc_id").join(per, "doc_id", "left").na.fill(0)
    return Scores(per, summed(per), time.monotonic() - began)


def summed(per: DataFrame) -> DataFrame:
    """(what, tp, fp, fn, precision, recall, f1, support, boundary_only, direction_swaps) over all documents, one row for entities and one for links."""
    total = per.agg(F.count(F.lit(1)).alias("n_docs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per.columns if c != "doc_id"])
    rows = None
    for what in ("entity", "link"):
        part = total.select(F.lit(what).alias("what"), "n_docs", *[F.col(f"{what}_{c}").alias(c) for c in ("tp", "fp", "fn")], "boundary_only", "direction_swaps")
        rows = part if rows is None else rows.unionByName(part)
    return evaluate.ratios(rows)


def score_graph(x: Extraction, gold: DataFrame) -> DataFrame:
    """(document_id, what, tp, fp, fn, precision, recall, f1, support) of extracted graphs against gold labels (document_id, entities, relations)."""
    g = gold.select("document_id", F.explode("entities").alias("e")).select("document_id", F.lit("entity").alias("what"), evaluate.entity_key(F.col("e.name"), F.col("e.type")).alias("k"))
    r = gold.select("document_id", F.explode("relations").alias("e")).select("document_id", F.lit("relation").alias("what"), evaluate.relation_key(F.col("e.source"), F.col("e.target"), F.col("e.type")).alias("k"))
    pe = x.entities.select("document_id", F.lit("entity").alias("what"), F.concat_ws("|", "name", "entity_type").alias("k"))
    pr = x.relationships.select("document_id", F.lit("relation").alias("what"), F.concat_ws("|", "source", "target", "relation_type").alias("k"))
    return evaluate.prf(pe.unionByName(pr), g.unionByName(r), ["document_id", "what", "k"], ["document_id", "what"])


def score_notes(notes: DataFrame, gold: DataFrame, groups: dict[str, tuple[Ontology, list[str] | None]], **options) -> Scores:
    """Extract and score labelled notes in groups, each with its own ontology: name -> (ontology, documents; None takes the rest).

    Labels without a note are left out. The summary has the micro averages of each group and of all (null).
    """
    began = time.monotonic()
    named = [d for _, docs in groups.values() for d in docs or ()]
    per = None
    for name, (ontology, documents) in groups.items():
        mine = F.col("document_id").isin(*documents) if documents is not None else ~F.col("document_id").isin(*named) if named else F.lit(True)
        part = notes.join(gold.select("document_id"), "document_id", "left_semi").where(mine)
        scored = score_graph(extract(part, ontology, **options), gold.join(part.select("document_id"), "document_id", "left_semi"))
        scored = scored.select(F.lit(name).alias("group"), "*")
        per = scored if per is None else per.unionByName(scored)
    summary = evaluate.ratios(per.rollup("what", "group").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).where(F.col("what").isNotNull()))
    return Scores(per, summary, time.monotonic() - began)
