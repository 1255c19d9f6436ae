"""The whole way from documents to a graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import assemble, decide, mentions, parsing
from ..operators.decide import Decider, Gate
from ..operators.ontology import Ontology
from ..session import cut_lineage


@dataclass(frozen=True)
class Extraction:
    """The frames of one extraction."""

    sentences: DataFrame
    mentions: DataFrame
    typed: DataFrame
    hits: DataFrame
    cut: DataFrame
    entities: DataFrame
    relationships: DataFrame
    items: DataFrame

    def lineage(self) -> DataFrame:
        return assemble.lineage(self.typed, self.hits)

    def statistics(self) -> DataFrame:
        return assemble.run_statistics(self.sentences, self.mentions, self.typed, self.hits, self.cut, self.entities, self.relationships)


def extract(
    docs: DataFrame, ontology: Ontology, gazetteer: DataFrame | None = None, gate: Gate = Gate(), blocks: bool = False, max_chars: int | None = None, capitals: bool = False,
    max_pairs: int = decide.PAIRS_PER_SENTENCE, keep: Callable[[DataFrame], DataFrame] = cut_lineage, decider: Decider | None = None, model: str = "rules", more: Iterable[Callable[[DataFrame], DataFrame]] = (),
) -> Extraction:
    """Extract a graph from (document_id, text).

    ``gazetteer`` may be any (name, type, ord) frame and replaces the ontology's own list. ``decider`` answers the
    questions whether a mention is a name, of which kind, and which links hold (``deciders``); without one rules do,
    in one lazy plan. With one, pass ``deciders.Kept`` so that answers are kept and asked once. ``more`` are further
    proposers, functions from sentences to mentions. ``keep`` is applied to the sentences and the typed mentions, which
    all outputs share, and to the hits where a decider was asked: by default they are written to the checkpoint folder
    once. Hits of the rules stay lazy, so that an output that needs no links decides none.
    """
    return extract_sentences(keep(parsing.sentences(docs, blocks, max_chars)), ontology, gazetteer, gate, capitals, max_pairs, keep, decider, model, more)


def extract_sentences(
    sents: DataFrame, ontology: Ontology, gazetteer: DataFrame | None = None, gate: Gate = Gate(), capitals: bool = False, max_pairs: int = decide.PAIRS_PER_SENTENCE,
    keep: Callable[[DataFrame], DataFrame] = cut_lineage, decider: Decider | None = None, model: str = "rules", more: Iterable[Callable[[DataFrame], DataFrame]] = (),
) -> Extraction:
    """The same from sentences that are parsed already."""
    spark = sents.sparkSession
    listed = gazetteer if gazetteer is not None else ontology.gazetteer(spark)
    found = mentions.propose(sents, listed, capitals, [step(sents) for step in more])
    typed = keep(assemble.in_document_order(decide.type_mentions(found, sents, listed, ontology, gate, decider, model), sents))
    predicates, cut = decide.legal_pairs(typed, ontology.signature_table(spark), max_pairs)
    hits = decide.decide_links(predicates, sents, ontology, gate, decider, model, found)
    if decider is not None:
        hits = keep(hits)
    routed = assemble.route_mentions(typed)
    entities = assemble.merge_entities(routed)
    links = assemble.route_links(hits, entities)
    return Extraction(sents, found, typed, hits, cut, entities, assemble.merge_links(links), assemble.queue(routed, links))
