"""Closed questions: their text, options, keys and packing; the checks and the numbers of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTRACT = "2"
GROUP = "GROUP_"
FEWEST_OPTIONS, MOST_OPTIONS = 2, 26
OPTIONS = "array<struct<label:string,description:string>>"
ABOUT = "struct<sentence:string,mention:string,src_text:string,tgt_text:string,relation:string>"
# a question and what it is about, which rules read instead of its text
QUESTION = f"question_key string, kind string, state string, instructions string, options {OPTIONS}, about {ABOUT}"
# How much goes into one request.
QUESTIONS_PER_CALL, TOKENS_PER_CALL, OVERHEAD_TOKENS, BYTES_PER_TOKEN = 64, 2000, 80, 4
PROBABILITY_SLACK = 0.05


def quoted(text: Column) -> Column:
    """A text in single quotes with backslashes and quotes escaped."""
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def name_question(sentence: Column, mention: Column) -> Column:
    return F.concat(F.lit("In sentence ("), quoted(sentence), F.lit("): Is mention ("), quoted(mention), F.lit(") a named entity of this ontology? A pronoun, a common word, or a negated mention is no."))


def kind_question(sentence: Column, mention: Column) -> Column:
    return F.concat(F.lit("In sentence ("), quoted(sentence), F.lit("): Which ontology type is mention ("), quoted(mention), F.lit(")?"))


def link_question(sentence: Column, relation: Column, source: Column, target: Column, description: Column) -> Column:
    return F.concat(
        F.lit("In sentence ("), quoted(sentence), F.lit("): Does "), relation, F.lit(" hold from "), quoted(source), F.lit(" to "), quoted(target), F.lit("? "), description,
        F.lit(" Negation and mere possibility are no."))


def state_text(heading: Column, sentence: Column, mentions: Column) -> Column:
    """The context of a sentence's questions: heading, sentence and its numbered mentions (array<string>)."""
    numbered = F.array_join(F.transform(mentions, lambda m, i: F.concat(F.lit("  ["), i.cast("string"), F.lit("] "), m)), "\n")
    head = F.when(F.coalesce(F.size(heading), F.lit(0)) > 0, F.array_join(heading, " > ")).otherwise(F.lit("(none)"))
    return F.concat_ws("\n", F.concat(F.lit("Heading: "), head), F.concat(F.lit("Sentence: "), sentence), F.lit("Mentions:"), numbered)


def group_question(sentence: Column, mention: Column) -> Column:
    return F.concat(F.lit("In sentence ("), quoted(sentence), F.lit("): Which type in this group is mention ("), quoted(mention), F.lit(")? Pick NOT_ENTITY if none."))


def options_of(pairs: list[tuple[str, str]]) -> Column:
    """Options (``OPTIONS``) in the given order."""
    return F.array(*[F.struct(F.lit(label).alias("label"), F.lit(text).alias("description")) for label, text in pairs]).cast(OPTIONS)


def choice_options(options: Column) -> Column:
    """The options of a choice question; fewer than two or more than 26 raise."""
    fits = F.size(options).between(FEWEST_OPTIONS, MOST_OPTIONS)
    return F.when(fits, options).otherwise(F.raise_error(F.format_string(f"a choice has {FEWEST_OPTIONS} to {MOST_OPTIONS} options, this one %d", F.size(options))).cast(OPTIONS))


def noul_options(yes: str, no: str) -> Column:
    """What yes and no mean, yes first."""
    return options_of([("true", yes), ("false", no)])


def score_options(levels: list[str]) -> Column:
    """The levels of a score question, from 0 up."""
    return choice_options(options_of([(str(i), text) for i, text in enumerate(levels)]))


def reversed_options(options: Column) -> Column:
    """The same options in reverse order, which makes another question with a key of its own."""
    return F.reverse(options)


def with_question(rows: DataFrame, model: str, kind: str, state: Column, instructions: Column, options: Column, about: dict[str, Column]) -> DataFrame:
    """rows with the columns of ``QUESTION``."""
    parts = [about.get(c, F.lit(None)).cast("string").alias(c) for c in ("sentence", "mention", "src_text", "tgt_text", "relation")]
    asked = rows.withColumns({"kind": F.lit(kind), "state": state, "instructions": instructions, "options": options, "about": F.struct(*parts)})
    return asked.withColumn("question_key", question_key(F.lit(model), F.col("state"), F.col("kind"), F.col("instructions"), F.col("options")))


QUESTION_COLUMNS = ("question_key", "kind", "state", "instructions", "options", "about")


def question_key(model: Column, state: Column, kind: Column, instructions: Column, options: Column) -> Column:
    """The key under which an answer is kept: the same question of the same model has the same key, however packed."""
    body = F.to_json(F.struct(F.lit(CONTRACT).alias("contract"), instructions.alias("instructions"), kind.alias("kind"), model.alias("model"), options.alias("options"), state.alias("state")))
    return F.sha2(body, 256)


def request_key(model: Column, body: Column) -> Column:
    """sha256 of a request's canonical text."""
    return F.sha2(F.to_json(F.struct(body.alias("body"), F.lit(CONTRACT).alias("contract"), model.alias("model"))), 256)


def estimated_tokens(text: Column) -> Column:
    return (F.ceil(F.octet_length(text) / BYTES_PER_TOKEN) + OVERHEAD_TOKENS).cast("int")


def pack(questions: DataFrame, keys: list[str], order: list[str], text: str, most: int = QUESTIONS_PER_CALL, most_tokens: int = TOKENS_PER_CALL) -> DataFrame:
    """Adds call_no: questions of one key in order fill a call until its number or its tokens would be too many.

    A greedy fill restarts at each call, so it is a fold over the key's questions, not a running sum; only
    their sizes go into it. A question too long for any call gets one of its own.
    """
    sized = questions.withColumn("tokens", estimated_tokens(F.col(text))).withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    per = sized.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("sizes"))
    start = F.struct(F.lit(0).alias("call"), F.lit(0).alias("n"), F.lit(0).alias("sum"), F.expr("cast(array() as array<struct<at:int,call:int>>)").alias("out"))

    def fill(acc: Column, x: Column) -> Column:
        full = (acc["n"] >= most) | ((acc["n"] > 0) & (acc["sum"] + x["tokens"] > most_tokens))
        call = (acc["call"] + full.cast("int")).cast("int")
        return F.struct(call.alias("call"), F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), F.when(full, x["tokens"]).otherwise(acc["sum"] + x["tokens"]).alias("sum"),
                        F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), call.alias("call")))).alias("out"))

    placed = per.select(*keys, F.explode(F.aggregate("sizes", start, fill)["out"]).alias("p")).select(*keys, "p.at", F.col("p.call").alias("call_no"))
    return sized.join(placed, [*keys, "at"]).drop("at")


# answers


ANSWER = "struct<type:string,choice:string,noul:double,score:double,confidence:double,probabilities:map<string,double>>"


def answer_problem(a: Column, asked: Column | None = None) -> Column:
    """Why an answer (``ANSWER``) cannot be used, or null. ``asked``: the labels of a choice question."""
    p = a["probabilities"]
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda s, x: s + x)
    outside = lambda x: ~(x.between(0.0, 1.0)) | F.isnan(x)
    choice = (
        F.when(a["choice"].isNull(), "no choice").when(p.isNull(), "no probabilities").when(~F.coalesce(F.map_contains_key(p, a["choice"]), F.lit(False)), "choice has no probability")
        .when(F.coalesce(F.exists(F.map_values(p), lambda x: x.isNull() | outside(x)), F.lit(False)), "probability out of range")
        .when(F.abs(total - 1) > PROBABILITY_SLACK, "probabilities do not sum to 1")
    )
    if asked is not None:
        choice = F.when(a["choice"].isNotNull() & ~F.array_contains(asked, a["choice"]), "choice was not asked").otherwise(choice)
    noul = F.when(a["noul"].isNull(), "no noul").when(outside(a["noul"]), "noul out of range")
    score = F.when(a["score"].isNull() | F.isnan(a["score"]) | (F.abs(a["score"]) == float("inf")), "no finite score")
    sure = F.when(a["confidence"].isNotNull() & outside(a["confidence"]), "confidence out of range")
    return F.when(a["type"].isNull(), "no type").when(sure.isNotNull(), sure).when(a["type"] == "choice", choice).when(a["type"] == "noul", noul).when(a["type"] == "score", score).otherwise("unknown type")


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the greatest."""
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def confidence(p: Column) -> Column:
    """1 - H(p) / ln n, held to 0..1; 1 for fewer than two options."""
    bits = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return F.when(F.size(p) < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - bits / F.ln(F.size(p)))))


def winner(p: Column) -> Column:
    """The place (from 0) of the greatest probability, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def expected_level(p: Column) -> Column:
    """The score of probabilities over levels 0, 1, 2...: sum of level x probability."""
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)


def option_letter(i: Column) -> Column:
    return F.char(F.lit(65) + i)


def prompt(kind: Column, state: Column, instructions: Column, options: Column) -> Column:
    """A question as a prompt that is answered by one letter: options lettered in their order, the label standing in for a missing description."""
    lettered = F.array_join(F.transform(options, lambda o, i: F.concat(option_letter(i), F.lit(". "), o["label"], F.lit(": "), F.coalesce(o["description"], o["label"]))), "\n")
    ask = F.when(kind == "noul", "Answer with the letter of true or false.").when(kind == "score", "Answer with the letter of the level.").otherwise("Answer with the letter of one option.")
    return F.concat_ws("\n\n", state, instructions, lettered, ask)


def answer_from_logits(kind: Column, labels: Column, logits: Column) -> Column:
    """An answer (``ANSWER``) from one logit for each option: the softmax, its winner and confidence; yes is the noul, levels weigh the score."""
    p = softmax(logits)
    shares = F.map_from_arrays(labels, p)
    none = F.lit(None).cast("double")
    return F.struct(
        kind.alias("type"), F.when(kind == "choice", F.element_at(labels, winner(p) + 1)).alias("choice"), F.when(kind == "noul", F.try_element_at(shares, F.lit("true"))).otherwise(none).alias("noul"),
        F.when(kind == "score", expected_level(p)).otherwise(none).alias("score"), F.when(kind != "noul", confidence(p)).otherwise(none).alias("confidence"), F.when(kind != "noul", shares).alias("probabilities"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.element_at(a, i) == F.element_at(b, i))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def compare_answers(a: DataFrame, b: DataFrame, slack: float = 0.15) -> DataFrame:
    """(question_key, status, greatest_gap): two deciders' answers to the same questions side by side.

    Both frames have question_key, choice, band and probabilities (map). status: 'same', 'differs' or 'missing'.
    """
    x = a.select("question_key", F.col("choice").alias("c1"), F.col("band").alias("b1"), F.col("probabilities").alias("p1"))
    y = b.select("question_key", F.col("choice").alias("c2"), F.col("band").alias("b2"), F.col("probabilities").alias("p2"))
    both = x.join(y, "question_key", "full_outer")
    labels = F.array_union(F.map_keys("p1"), F.map_keys("p2"))
    gap = F.array_max(F.transform(labels, lambda k: F.abs(F.coalesce(F.try_element_at("p1", k), F.lit(0.0)) - F.coalesce(F.try_element_at("p2", k), F.lit(0.0)))))
    missing = F.col("p1").isNull() | F.col("p2").isNull()
    same = (gap <= slack) & F.col("c1").eqNullSafe(F.col("c2")) & (F.col("b1") == F.col("b2"))
    return both.select("question_key", F.when(missing, "missing").when(same, "same").otherwise("differs").alias("status"), F.when(~missing, gap).alias("greatest_gap"))
