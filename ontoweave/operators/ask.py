"""The questions of an extraction: worded, asked of a decider, their answers read back.

Every question carries the state of its own sentence (heading, sentence, numbered mentions) and quotes it, so that
an answer does not hang on how questions are packed. Answers fail closed: a question without a usable answer raises.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import questions as Q
from .ontology import NOT_ENTITY, NOT_ENTITY_TEXT, Ontology

if TYPE_CHECKING:
    from .decide import Gate

Decider = Callable[[DataFrame], DataFrame]


def states(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """(document_id, sentence_id, state): the context of each sentence's questions."""
    keys = ["document_id", "sentence_id"]
    listed = mentions.where(F.col("skipped_reason").isNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "text"))).alias("m"))
    rows = sentences.join(listed, keys, "left")
    texts = F.coalesce(F.transform("m", lambda x: x["text"]), F.expr("cast(array() as array<string>)"))
    return rows.select(*keys, Q.state_text(F.col("heading_path"), F.col("text"), texts).alias("state"))


def answered(questions: DataFrame, decider: Decider) -> DataFrame:
    """questions with their answers; one that is missing, of another kind or not usable raises."""
    answers = decider(questions.select(*Q.QUESTION_COLUMNS)).groupBy("question_key").agg(F.any_value("answer").alias("answer"))
    rows = questions.join(answers, "question_key", "left")
    labels = F.when(F.col("kind") == "choice", F.transform("options", lambda o: o["label"]))
    other = F.when(F.col("answer.type") != F.col("kind"), F.concat(F.lit("expected "), F.col("kind"), F.lit(", got "), F.col("answer.type")))
    problem = F.when(F.col("answer").isNull(), "no answer").otherwise(F.coalesce(other, Q.answer_problem(F.col("answer"), labels)))
    wrong = F.concat(F.lit("unusable answer: "), problem)
    # the check is part of the answer, so that no plan can leave it out
    return rows.withColumn("answer", F.when(problem.isNull(), F.col("answer")).otherwise(F.raise_error(wrong).cast(Q.ANSWER)))


def names(rows: DataFrame, decider: Decider, model: str) -> DataFrame:
    """rows (mentions with sentence and state) with p_yes: how likely each is a name."""
    text = Q.name_question(F.col("sentence"), F.col("text"))
    options = Q.noul_options("A named entity this ontology can type.", "Not a named entity in this ontology.")
    asked = Q.with_question(rows, model, "noul", F.col("state"), text, options, {"sentence": F.col("sentence"), "mention": F.col("text")})
    return answered(asked, decider).select(*rows.columns, F.col("answer.noul").alias("p_yes"))


def _chosen(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.col("answer.choice").alias("choice"), F.coalesce(F.try_element_at("answer.probabilities", F.col("answer.choice")), F.lit(0.0)).alias("winner_prob"), F.col("answer.confidence").alias("confidence"))


def kinds(rows: DataFrame, decider: Decider, model: str, ontology: Ontology, gate: Gate) -> DataFrame:
    """rows with choice, winner_prob, confidence and flipped: the kind of each name."""
    keep = rows.columns
    about = {"sentence": F.col("sentence"), "mention": F.col("text")}
    grouped = ontology.needs_groups()
    groups = ontology.groups()
    pairs = [(f"{Q.GROUP}{i}", ", ".join(k.id for k in g)) for i, g in enumerate(groups)] if grouped else [(k.id, k.description) for k in ontology.kinds]
    options = Q.choice_options(Q.options_of(pairs))
    text = Q.kind_question(F.col("sentence"), F.col("text"))

    def ask(part: DataFrame, offered: Column, wording: Column) -> DataFrame:
        columns = part.columns
        return _chosen(answered(Q.with_question(part, model, "choice", F.col("state"), wording, offered, about), decider), columns)

    first = ask(rows, options, text).withColumn("flipped", F.lit(False))
    if gate.rotate_below_confidence > 0:
        unsure = gate.rotates(F.col("confidence"))
        again = first.where(unsure).withColumnsRenamed({"choice": "c1", "winner_prob": "p1", "confidence": "s1"}).drop("flipped")
        again = ask(again, Q.reversed_options(options), text).withColumn("flipped", F.col("choice") != F.col("c1"))
        pick = lambda a, b: F.when(F.col("flipped"), F.col(a)).otherwise(F.col(b)).alias(a)
        again = again.select(*keep, pick("choice", "c1"), pick("winner_prob", "p1"), pick("confidence", "s1"), "flipped")
        first = first.where(~F.coalesce(unsure, F.lit(False))).unionByName(again)
    if not grouped:
        return first
    within = F.element_at(
        F.array(*[Q.options_of([*((k.id, k.description) for k in g), (NOT_ENTITY, NOT_ENTITY_TEXT)]) for g in groups]),
        F.regexp_extract("g", rf"^{Q.GROUP}(\d+)$", 1).cast("int") + 1)
    second = first.withColumnRenamed("choice", "g").drop("winner_prob", "confidence")
    return ask(second, Q.choice_options(within), Q.group_question(F.col("sentence"), F.col("text"))).drop("g")


def links(rows: DataFrame, decider: Decider, model: str, ontology: Ontology) -> DataFrame:
    """rows (predicates with sentence and state) with prob: how likely the sentence states each."""
    texts = ontology.link_table(rows.sparkSession).select(F.col("id").alias("relation"), F.col("description").alias("_said"))
    told = rows.join(F.broadcast(texts), "relation", "left")
    text = Q.link_question(F.col("sentence"), F.col("relation"), F.col("src_text"), F.col("tgt_text"), F.coalesce("_said", F.lit("")))
    yes = F.concat(F.lit("The sentence asserts "), F.col("relation"), F.lit(" from the first mention to the second."))
    no = F.concat(F.lit("The sentence does not assert "), F.col("relation"), F.lit(" in this direction."))
    options = F.array(F.struct(F.lit("true").alias("label"), yes.alias("description")), F.struct(F.lit("false").alias("label"), no.alias("description"))).cast(Q.OPTIONS)
    about = {c: F.col(c) for c in ("sentence", "src_text", "tgt_text", "relation")}
    asked = Q.with_question(told, model, "noul", F.col("state"), text, options, about)
    return answered(asked, decider).select(*rows.columns, F.col("answer.noul").alias("prob"))
