"""Who answers questions: rules, listed names, kept answers, a host; and the table that keeps answers.

A decider is a function from a frame of questions (``questions.QUESTION``) to a frame of ``ANSWERED``: one answer
for each key. Rules and tables are plain expressions and joins and stay lazy; a host is asked from the executors,
and ``Kept`` writes its answers down before anything reads them, so that a plan that is computed twice, or the loss
of an executor, asks nothing twice.
"""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import questions as Q
from .grounding import retry_waits
from .ontology import Ontology

ANSWERED = f"question_key string, answer {Q.ANSWER}, input_tokens bigint, output_tokens bigint"
Decider = Callable[[DataFrame], DataFrame]
Post = Callable[[dict], dict]


def choice_answer(label: Column, p: Column, options: Column, sure: Column) -> Column:
    """A choice answer: the label has p, the other options share the rest."""
    rest = (1 - p) / F.greatest(F.size(options) - 1, F.lit(1))
    shares = F.map_from_entries(F.transform(options, lambda o: F.struct(o["label"].alias("key"), F.when(o["label"] == label, p).otherwise(rest).alias("value"))))
    none = F.lit(None).cast("double")
    return F.struct(F.lit("choice").alias("type"), label.alias("choice"), none.alias("noul"), none.alias("score"), sure.alias("confidence"), shares.alias("probabilities")).cast(Q.ANSWER)


def noul_answer(p: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit("noul").alias("type"), none.cast("string").alias("choice"), p.cast("double").alias("noul"), none.cast("double").alias("score"), none.cast("double").alias("confidence"), none.cast("map<string,double>").alias("probabilities"))


def free(answers: DataFrame) -> DataFrame:
    return answers.select("question_key", "answer", F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))


def _listed_label(kind: Column, options: Column) -> Column:
    """The option that stands for a kind: itself, the group that names it, else the first by name."""
    labels = F.transform(options, lambda o: o["label"])
    group = F.try_element_at(F.filter(options, lambda o: F.startswith(o["label"], F.lit(Q.GROUP)) & F.array_contains(F.split(o["description"], ", "), kind)), F.lit(1))
    return F.when(F.array_contains(labels, kind), kind).otherwise(F.coalesce(group["label"], F.array_min(labels)))


def rule_decider(ontology: Ontology) -> Decider:
    """Answers by the wording of the sentence: no model is needed."""
    from . import decide

    def answer(questions: DataFrame) -> DataFrame:
        links = questions.where(F.col("about.relation").isNotNull()).select("question_key", "about.sentence", "about.src_text", "about.tgt_text", "about.relation")
        names = questions.where(F.col("about.relation").isNull() & (F.col("kind") == "noul"))
        kinds = questions.where(F.col("about.relation").isNull() & (F.col("kind") == "choice")).select("question_key", "options", "about.sentence", F.col("about.mention").alias("text"), F.lit(None).cast("string").alias("listed_type"))
        a = decide.rule_links(links, ontology).select("question_key", noul_answer(F.col("prob")).alias("answer"))
        b = names.select("question_key", noul_answer(decide.rule_name(F.col("about.mention"), F.col("about.sentence"), F.lit(False))).alias("answer"))
        c = decide.rule_kinds(kinds, ontology).withColumn("label", _listed_label(F.col("choice"), F.col("options")))
        c = c.select("question_key", choice_answer(F.col("label"), F.col("winner_prob"), F.col("options"), F.col("confidence")).alias("answer"))
        return free(a.unionByName(b).unionByName(c))

    return answer


def listed_decider(gazetteer: DataFrame) -> Decider:
    """A small decider for tests: yes unless the sentence negates or hedges, kinds from a list of names."""
    from . import decide

    # fixed values: what it answers
    yes, no, mass, unknown = 0.95, 0.05, 0.92, 0.4

    def answer(questions: DataFrame) -> DataFrame:
        sentence = F.col("about.sentence")
        noul = F.when(sentence.rlike(decide.NEGATION) | sentence.rlike(decide.HEDGE), no).otherwise(yes)
        nouls = questions.where(F.col("kind") == "noul").select("question_key", noul_answer(noul).alias("answer"))
        listed = gazetteer.groupBy(F.col("name").alias("listed_name")).agg(F.min("type").alias("listed_type"))
        rows = questions.where(F.col("kind") == "choice").join(listed, F.col("about.mention") == F.col("listed_name"), "left")
        known = F.col("listed_type").isNotNull()
        label = _listed_label(F.col("listed_type"), F.col("options"))
        p = F.when(known, F.lit(mass)).otherwise(unknown)
        return free(nouls.unionByName(rows.select("question_key", choice_answer(label, p, F.col("options"), p).alias("answer"))))

    return answer


def table_decider(answers: DataFrame) -> Decider:
    """Answers from a table (question_key, answer, created_at); the latest of a key counts, questions without one get none."""

    def answer(questions: DataFrame) -> DataFrame:
        latest = answers.groupBy("question_key").agg(F.max_by("answer", F.struct("created_at", F.to_json("answer"))).alias("answer"))
        return free(questions.select("question_key").distinct().join(latest, "question_key"))

    return answer


def function_decider(post: Post, model: str, most: int = Q.QUESTIONS_PER_CALL, most_tokens: int = Q.TOKENS_PER_CALL) -> Decider:
    """Asks ``post``, a function from a request to a response, with the packed questions of one state at a time.

    ``post`` runs on the executors. A request that it finds too long (``TooLong``) is asked in halves, whose usage
    is summed; one question that is too long by itself raises.
    """

    def ask(rows: list[tuple]) -> tuple[dict[str, dict], int, int]:
        try:
            found = post({"model": model, "state": rows[0][1], "questions": {key: _request(kind, text, options) for key, _, kind, text, options in rows}})
        except TooLong:
            if len(rows) < 2:
                raise
            parts = [ask(part) for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :])]
            return parts[0][0] | parts[1][0], parts[0][1] + parts[1][1], parts[0][2] + parts[1][2]
        usage = found.get("usage") or {}
        return found["answers"], int(usage.get("input_tokens") or 0), int(usage.get("output_tokens") or 0)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("question_key")[["question_key", "state", "kind", "instructions", "options"]].itertuples(index=False, name=None))
        answers, came, went = ask(rows)
        if missing := [r[0] for r in rows if r[0] not in answers]:
            raise ValueError(f"no answer to {len(missing)} of {len(rows)} questions")
        # the usage of a call stands on its first row
        return pd.DataFrame([(r[0], json.dumps(answers[r[0]]), came if i == 0 else 0, went if i == 0 else 0) for i, r in enumerate(rows)], columns=["question_key", "answer_json", "input_tokens", "output_tokens"])

    def answer(questions: DataFrame) -> DataFrame:
        packed = Q.pack(questions.select("question_key", "state", "kind", "instructions", "options"), ["state"], ["question_key"], "instructions", most, most_tokens)
        asked = packed.groupBy("state", "call_no").applyInPandas(call, "question_key string, answer_json string, input_tokens long, output_tokens long")
        return asked.select("question_key", F.from_json("answer_json", Q.ANSWER).alias("answer"), "input_tokens", "output_tokens")

    return answer


def _request(kind: str, instructions: str, options) -> dict:
    """A question as hosts read it; options keep their order."""
    criteria = {o["label"]: o["description"] for o in (options if options is not None else ())}
    return {"type": kind, "instructions": instructions, "criteria": criteria}


class TooLong(ValueError):
    """A host finds a request too long."""


class HostError(RuntimeError):
    """A host does not answer as it should."""


def http_post(url: str, timeout: float = 60.0, waits: list[float] | None = None) -> Post:
    """Posts a request as JSON. A busy host (429, 503) is asked again after each of the waits; all else fails at once."""
    pauses = retry_waits() if waits is None else waits

    def post(body: dict) -> dict:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        for pause in [*pauses, None]:
            try:
                with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout) as reply:
                    return json.load(reply)
            except HTTPError as e:
                said = e.read().decode("utf-8", "replace")
                if e.code == 413 or e.code == 400 and any(w in said.lower() for w in ("token", "context", "too long")):
                    raise TooLong(said[:200]) from None
                if e.code not in (429, 503) or pause is None:
                    raise HostError(f"{e.code}: {said[:200]}") from None
                time.sleep(pause)
        raise HostError("no answer")

    return post


def http_decider(url: str, model: str, timeout: float = 60.0, waits: list[float] | None = None) -> Decider:
    return function_decider(http_post(url, timeout, waits), model)


@dataclass
class Kept:
    """A decider whose answers are kept in a table: only questions without a kept answer are asked, each once.

    The table is read again at every call, so all that share the path share the answers. ``counts`` sums up
    questions, hits, newly answered ones and their tokens; moving a cut-off bands kept answers anew and asks
    nothing. Answers that cannot be used are not kept, so they are asked again.
    """

    spark: SparkSession
    decider: Decider
    path: str
    counts: Counter = field(default_factory=Counter)

    def known(self) -> DataFrame:
        schema = f"{ANSWERED}, created_at timestamp"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _sums(self) -> tuple[int, int, int]:
        r = self.known().agg(F.countDistinct("question_key").alias("n"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("i"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("o")).first()
        return r.n, r.i, r.o

    def __call__(self, questions: DataFrame) -> DataFrame:
        rows = cut_lineage(questions.groupBy("question_key").agg(*[F.any_value(c).alias(c) for c in questions.columns if c != "question_key"]))
        before = self._sums()
        new = rows.join(self.known().select("question_key").distinct(), "question_key", "left_anti")
        got = self.decider(new)
        got = got.where(F.col("answer").isNotNull() & Q.answer_problem(F.col("answer")).isNull())
        got.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(self.path)
        after, total = self._sums(), rows.count()
        self.counts.update(questions=total, answered=after[0] - before[0], hits=total - (after[0] - before[0]), input_tokens=after[1] - before[1], output_tokens=after[2] - before[2])
        # written out: two readings of one growing folder look alike to the planner, which would take one for the other
        return cut_lineage(table_decider(self.known())(rows))
