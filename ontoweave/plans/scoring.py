"""Queries of decisions, gates, pairs, keys, scores, curves and kept tables over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide, deciders, evaluate, export, grounding, ontology
from ..operators import questions as Q
from ..sources import files
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
GATE = decide.Gate()


def _logits(spark: SparkSession, d: str, at: int = 1, n: int = 4) -> DataFrame:
    """(vec_id, label, p): probabilities over n options, read off the embeddings."""
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", "label", Q.softmax(F.transform(F.slice("embedding", at, n), lambda x: x.cast("double") * 4)).alias("p"))


def option_answers(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return _logits(spark, d).select("vec_id", Q.winner(p).alias("choice"), F.round(F.array_max(p), 6).alias("winner_prob"), F.round(Q.confidence(p), 6).alias("confidence"), F.round(Q.expected_level(p), 6).alias("score"))


def choice_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = _logits(spark, d).select("vec_id", Q.winner(F.col("p")).cast("string").alias("choice"), F.round(F.array_max("p"), 6).alias("p"), F.round(Q.confidence(F.col("p")), 6).alias("sure"), (F.col("label") == 1).alias("flipped"))
    return rows.select("vec_id", GATE.choice(F.col("choice"), F.col("p"), F.col("sure"), F.col("flipped"), ("3",)).alias("band"))


def noul_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = _logits(spark, d, n=2).select("label", F.round(F.element_at("p", 1), 6).alias("prob")).withColumn("band", GATE.noul(F.col("prob")))
    return evaluate.band_counts(rows, ["label"])


def rotated_answers(spark: SparkSession, d: str) -> DataFrame:
    answers = lambda at: _logits(spark, d, at).select(F.col("vec_id").alias("question_key"), Q.winner(F.col("p")).alias("choice"), F.round(F.array_max("p"), 6).alias("winner_prob"), F.round(Q.confidence(F.col("p")), 6).alias("confidence"))
    return decide.rotate(answers(1), answers(5), decide.Gate(rotate_below_confidence=0.5))


def compared_answers(spark: SparkSession, d: str) -> DataFrame:
    def answers(at: int) -> DataFrame:
        rows = _logits(spark, d, at, 2).select(F.col("vec_id").alias("question_key"), F.transform("p", lambda x: F.round(x, 6)).alias("p"))
        return rows.select("question_key", Q.winner(F.col("p")).alias("choice"), GATE.noul(F.element_at("p", 1)).alias("band"), F.map_from_arrays(F.array(F.lit("yes"), F.lit("no")), F.col("p")).alias("probabilities"))

    out = Q.compare_answers(answers(1), answers(3))
    return out.select("question_key", "status", F.round("greatest_gap", 6).alias("greatest_gap"))


def kind_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(ontology.group_of(F.col("p_size") - 1).alias("group_no")).agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


def _typed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as accepted mentions of one sentence per order."""
    kind = F.when(F.col("l_returnflag") == "A", "SUPPLIER").when(F.col("l_returnflag") == "N", "NATION").otherwise("REGION")
    rows = table(spark, d, "lineitem")
    return rows.select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.lit("s0").alias("sentence_id"), F.col("l_partkey").cast("string").alias("text"), kind.alias("entity_type"),
        F.when(F.col("l_linestatus") == "O", "ACCEPT").otherwise("REVIEW").alias("band"), (F.col("l_linenumber") * 10).alias("start_char"), (F.col("l_linenumber") * 10 + 5).alias("end_char"), F.col("l_linenumber").alias("t_ord"))


def legal_predicates(spark: SparkSession, d: str) -> DataFrame:
    found, _ = decide.legal_pairs(_typed_lines(spark, d), ontology.load("trade").signature_table(spark), 4)
    return found.select("document_id", "src_ord", "tgt_ord", "relation", "p_ord")


def pairs_cut(spark: SparkSession, d: str) -> DataFrame:
    _, cut = decide.legal_pairs(_typed_lines(spark, d), ontology.load("trade").signature_table(spark), 4)
    return cut.select("document_id", "pairs_cut")


def signatures(spark: SparkSession, d: str) -> DataFrame:
    return ontology.load("trade").signature_table(spark).select("src_type", "tgt_type", "relation")


def event_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the events' bodies, as requests; copies of a body have one key."""
    rows = table(spark, d, "events").select(Q.request_key(F.col("event_type"), F.col("props")).alias("cache_key"))
    return rows.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"))


def event_misses(spark: SparkSession, d: str) -> DataFrame:
    """Users and kinds of event asked for (all events) without a kept answer (their events worth more than 50)."""
    rows = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("question_key"), "value")
    return decide.misses(rows.select("question_key"), rows.where(F.col("value") > 50).select("question_key"))


def packed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each document's sentences as questions."""
    rows = table(spark, d, "sentences").select("document_id", "idx", "text").where(F.col("text").isNotNull()).distinct()
    return Q.pack(rows, ["document_id"], ["idx", "text"], "text").groupBy("document_id", "call_no").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


MANY = 40


def grouped_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Parts as names of one of 40 kinds, too many for one question: asked for the group, then within it."""
    onto = ontology.Ontology("many", tuple(ontology.Kind(f"K{i:02d}", f"Kind {i}.") for i in range(MANY)), ())
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("document_id"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("text"), F.pmod("p_size", F.lit(MANY)).cast("int").alias("kind_no"))
    none = F.expr("cast(array() as array<string>)")
    sentences = part.select("document_id", F.concat("document_id", F.lit("-s0")).alias("sentence_id"), F.lit(0).alias("idx"), "text", F.lit(0).alias("start_char"), none.alias("heading_path"))
    found = sentences.select("document_id", "sentence_id", "text", "start_char", F.length("text").alias("end_char"), F.lit("encoder").alias("source"), F.lit(None).cast("string").alias("skipped_reason"), "heading_path", F.lit(0).alias("m_ord"))

    def decider(questions: DataFrame) -> DataFrame:
        rows = questions.join(part.select(F.col("text").alias("_name"), "kind_no"), F.col("about.mention") == F.col("_name"))
        group = F.concat(F.lit(Q.GROUP), ontology.group_of(F.col("kind_no")).cast("string"))
        label = F.when(F.startswith(F.element_at("options", 1)["label"], F.lit(Q.GROUP)), group).otherwise(F.format_string("K%02d", F.col("kind_no")))
        answer = F.when(F.col("kind") == "noul", deciders.noul_answer(F.lit(0.9))).otherwise(deciders.choice_answer(label, F.lit(0.85), F.col("options"), F.lit(0.9)))
        return deciders.free(rows.select("question_key", answer.alias("answer")))

    return decide.type_mentions(found, sentences, onto.gazetteer(spark), onto, GATE, decider, "t").select("document_id", "entity_type", "band", F.round("winner_prob", 6).alias("winner_prob"))


def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the kept answers of decisions, as counts."""
    schema = f"answers map<string,{Q.ANSWER}>"
    rows = table(spark, d, "decisions").select("cache_key", F.from_json("response_json", schema).alias("r")).select("cache_key", F.explode("r.answers").alias("question", "answer"))
    return rows.select(F.coalesce(Q.answer_problem(F.col("answer")), F.lit("usable")).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(predicted, gold): who a customer's nation is said to be, and is. Predictions miss and add by balance."""
    c = table(spark, d, "customer")
    gold = c.select(F.col("c_mktsegment").alias("doc_id"), F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("target"))
    pred = c.where(F.col("c_acctbal") >= 0).select(F.col("c_mktsegment").alias("doc_id"), F.col("c_custkey").alias("source"), F.when(F.col("c_acctbal") > 9000, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("target"))
    return pred, gold


def segment_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.prf(*_links(spark, d), ["doc_id", "source", "target"], ["doc_id"]))


def total_scores(spark: SparkSession, d: str) -> DataFrame:
    per = evaluate.counts(*_links(spark, d), ["doc_id", "source", "target"], ["doc_id"])
    return _rounded(evaluate.micro_average(per, ["doc_id"]))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def span_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start_char"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 5).alias("end_char"),
        F.col("l_returnflag").alias("g"), F.when(F.col("l_discount") > 0.08, "X").otherwise(F.col("l_returnflag")).alias("p"), F.col("l_partkey").alias("part"), F.col("l_tax").alias("tax"))
    e = lambda c: rows.select("doc_id", "start_char", "end_char", F.col(c).alias("type"))
    end = F.col("part") + 1_000_000_000_000
    gold = rows.select("doc_id", F.col("start_char").alias("src_start"), F.col("end_char").alias("src_end"), end.alias("tgt_start"), (end + 3).alias("tgt_end"), F.lit("L").alias("type"))
    turned = F.col("tax") > 0.06
    pick = lambda a, b: F.when(turned, b).otherwise(a)
    pred = rows.select("doc_id", pick(F.col("start_char"), end).alias("src_start"), pick(F.col("end_char"), end + 3).alias("src_end"), pick(end, F.col("start_char")).alias("tgt_start"), pick(end + 3, F.col("end_char")).alias("tgt_end"), F.lit("L").alias("type"))
    return evaluate.span_scores(e("p"), e("g"), pred, gold)


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return rows.select("o_orderpriority", F.round(F.col("o_totalprice") / 600000, 4).alias("prob"), (F.col("o_orderstatus") == "F").alias("correct"), F.col("o_orderkey").alias("ord"))


def precision_curve(spark: SparkSession, d: str) -> DataFrame:
    points = evaluate.curve(_decisions(spark, d), ["o_orderpriority"])
    return points.select("o_orderpriority", "rank", "threshold", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


def fitted_gates(spark: SparkSession, d: str) -> DataFrame:
    points = evaluate.curve(_decisions(spark, d), ["o_orderpriority"])
    out = evaluate.fit_gate(points, ["o_orderpriority"], 0.6)
    return out.select("o_orderpriority", F.round("accept_prob", 6).alias("accept_prob"), F.round("reject_prob", 6).alias("reject_prob"))


def latencies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.round("value", 4).alias("ms"), F.lit(2).alias("n"))
    out = evaluate.latency_summary(rows, ["event_type"], "ms", "n")
    return out.select("event_type", *[F.round(c, 3).alias(c) for c in ("mean_ms", "median_ms", "ms_per_question")])


def latest_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decisions").select("cache_key", "model", "body_hash", "created_at")
    return files.latest_by_key(rows, "cache_key", "created_at").select("cache_key", "model", "body_hash", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "runs").select("run_id", "document_id", "model", "ontology_id", "finished_at")
    return files.latest_by_key(rows, "run_id", "finished_at").select("run_id", "document_id", "model", "ontology_id", F.unix_micros(F.col("finished_at").cast("timestamp")).alias("finished_us"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_gold(table(spark, d, "label_files").select("document_id", "body"), "body")


def gold_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = _gold(spark, d).where(F.col("document_id").isNotNull()).select("document_id", F.explode("entities").alias("e"))
    return rows.where(F.col("e.name").isNotNull() & F.col("e.type").isNotNull()).select("document_id", "e.name", "e.type").distinct()


def gold_without_notes(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose note is not among the documents with a text."""
    docs = table(spark, d, "documents").where(F.coalesce("text", F.lit("")) != "").select("document_id", "text")
    _, alone = files.pair_gold(_gold(spark, d).where(F.col("document_id").isNotNull()), docs)
    return alone.select("document_id").distinct()


def grounded_replies(spark: SparkSession, d: str) -> DataFrame:
    """The label bodies as if chat replies had brought them, grounded in an ontology of their kinds."""
    kinds = tuple(ontology.Kind(k, k.title()) for k in ("PERSON", "ORGANIZATION", "PRODUCT", "TECHNOLOGY"))
    onto = ontology.Ontology("replies", kinds, (ontology.Link("USES", "Uses.", ("PERSON",), ("PRODUCT",)),))
    raw = table(spark, d, "label_files").where(F.col("document_id").isNotNull()).select("document_id", "body").distinct()
    replies = raw.select("document_id", F.concat(F.lit("Here it is:\n```json\n"), "body", F.lit("\n```\n")).alias("content"))
    entities, _ = grounding.ground(grounding.parse_replies(replies), onto)
    return entities.select("document_id", "name", "entity_type", "display_name")


def result_entities(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the entities in the runs' results that have the plain layout."""
    rows = files.parse_results(table(spark, d, "runs"), "run_id", "result_json").select(F.explode("entities").alias("e"))
    return rows.groupBy(F.col("e.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def cut_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of each nation's customers by balance, and how many more there are."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("document_id"), "c_custkey", (-F.col("c_acctbal")).alias("low"))
    return export.listing(rows, ["low", "c_custkey"], 5).select("document_id", "c_custkey", "place", "more")


QUERIES = (
    option_answers, choice_bands, noul_bands, rotated_answers, compared_answers, kind_groups, legal_predicates, pairs_cut, signatures, event_keys, event_misses, grouped_kinds, packed_calls, answer_checks,
    segment_scores, total_scores, span_scores, precision_curve, fitted_gates, latencies, latest_answers, latest_runs, gold_entities, gold_without_notes, grounded_replies, result_entities, cut_listing,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def _sql_logits(at: int = 1, n: int = 4) -> str:
    return f"""
      raised{at} AS (SELECT vec_id, label, list_transform(embedding[{at}:{at + n - 1}], lambda x: CAST(x AS DOUBLE) * 4) AS z FROM embeddings),
      ex{at} AS (SELECT vec_id, label, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM raised{at}),
      pr{at} AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex{at}),
      ans{at} AS (SELECT vec_id, label, p, list_position(p, list_max(p)) - 1 AS choice, round(list_max(p), 6) AS winner_prob,
                  round(greatest(0, least(1, 1 + list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln({n}))), 6) AS confidence FROM pr{at})"""


TYPED = """
  typed AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber AS t_ord, CASE WHEN l_returnflag = 'A' THEN 'SUPPLIER' WHEN l_returnflag = 'N' THEN 'NATION' ELSE 'REGION' END AS kind
            FROM lineitem WHERE l_linestatus = 'O'),
  sig(a, b, relation) AS (VALUES ('SUPPLIER', 'NATION', 'LOCATED_IN'), ('NATION', 'REGION', 'PART_OF'), ('SUPPLIER', 'SUPPLIER', 'DEPENDS_ON')),
  legal AS (SELECT x.document_id, x.t_ord AS src_ord, y.t_ord AS tgt_ord, relation FROM typed x JOIN typed y ON x.document_id = y.document_id AND x.t_ord <> y.t_ord JOIN sig ON a = x.kind AND b = y.kind),
  ranked AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY document_id ORDER BY src_ord, tgt_ord) AS INTEGER) AS p_ord FROM legal)
"""
LINKS = """
  gold AS (SELECT DISTINCT c_mktsegment AS doc_id, c_custkey AS source, c_nationkey AS target FROM customer),
  pred AS (SELECT DISTINCT c_mktsegment AS doc_id, c_custkey AS source, CASE WHEN c_acctbal > 9000 THEN c_nationkey + 1 ELSE c_nationkey END AS target FROM customer WHERE c_acctbal >= 0),
  both_ AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, p.source IS NOT NULL AS in_p, g.source IS NOT NULL AS in_g FROM pred p FULL JOIN gold g ON p.doc_id = g.doc_id AND p.source = g.source AND p.target = g.target),
  cnt AS (SELECT doc_id, CAST(count(*) FILTER (in_p AND in_g) AS BIGINT) AS tp, CAST(count(*) FILTER (in_p AND NOT in_g) AS BIGINT) AS fp, CAST(count(*) FILTER (in_g AND NOT in_p) AS BIGINT) AS fn FROM both_ GROUP BY doc_id)
"""
RATIOS = """doc_id, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0), 6) AS f1, tp + fn AS support"""
CURVE = """
  dec AS (SELECT o_orderpriority, round(o_totalprice / 600000, 4) AS prob, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS ok, o_orderkey FROM orders),
  points AS (SELECT o_orderpriority, prob AS threshold, count(*) OVER w AS rank, count(*) OVER w / count(*) OVER (PARTITION BY o_orderpriority) AS coverage, sum(ok) OVER w / count(*) OVER w AS prec
             FROM dec WINDOW w AS (PARTITION BY o_orderpriority ORDER BY prob DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def oracle_sql() -> dict[str, str]:
    bands = "CASE WHEN label = 1 THEN 'REVIEW' WHEN choice = 3 THEN CASE WHEN winner_prob >= 0.7 THEN 'REJECT' ELSE 'REVIEW' END WHEN winner_prob >= 0.7 AND confidence >= 0.5 THEN 'ACCEPT' WHEN winner_prob <= 0.4 THEN 'REJECT' ELSE 'REVIEW' END"
    noul = "CASE WHEN {0} >= 0.8 THEN 'ACCEPT' WHEN {0} <= 0.2 THEN 'REJECT' ELSE 'REVIEW' END"
    return {
        "option_answers": f"WITH {_sql_logits()} SELECT vec_id, CAST(choice AS INTEGER) AS choice, winner_prob, confidence, round(p[2] + 2 * p[3] + 3 * p[4], 6) AS score FROM ans1",
        "choice_bands": f"WITH {_sql_logits()} SELECT vec_id, {bands} AS band FROM ans1",
        "noul_bands": f"""WITH {_sql_logits(n=2)}, b AS (SELECT label, {noul.format('round(p[1], 6)')} AS band FROM ans1)
            SELECT label, count(*) FILTER (band = 'ACCEPT') AS "ACCEPT", count(*) FILTER (band = 'REVIEW') AS "REVIEW", count(*) FILTER (band = 'REJECT') AS "REJECT" FROM b GROUP BY label""",
        "rotated_answers": f"""WITH {_sql_logits(1)}, {_sql_logits(5)}, j AS (SELECT a.vec_id, a.choice AS c1, b.choice AS c2, a.winner_prob AS p1, b.winner_prob AS p2, a.confidence AS s1, b.confidence AS s2, a.confidence < 0.5 AND a.choice <> b.choice AS flipped FROM ans1 a JOIN ans5 b ON a.vec_id = b.vec_id)
            SELECT vec_id AS question_key, CAST(CASE WHEN flipped THEN c2 ELSE c1 END AS INTEGER) AS choice, CASE WHEN flipped THEN p2 ELSE p1 END AS winner_prob, CASE WHEN flipped THEN s2 ELSE s1 END AS confidence, flipped FROM j""",
        "compared_answers": f"""WITH {_sql_logits(1, 2)}, {_sql_logits(3, 2)},
            j AS (SELECT a.vec_id, round(a.p[1], 6) AS y1, round(b.p[1], 6) AS y2, round(a.p[2], 6) AS n1, round(b.p[2], 6) AS n2 FROM ans1 a JOIN ans3 b ON a.vec_id = b.vec_id),
            g AS (SELECT *, greatest(abs(y1 - y2), abs(n1 - n2)) AS gap, CASE WHEN y1 >= n1 THEN 0 ELSE 1 END AS c1, CASE WHEN y2 >= n2 THEN 0 ELSE 1 END AS c2 FROM j)
            SELECT vec_id AS question_key, CASE WHEN gap <= 0.15 AND c1 = c2 AND {noul.format('y1')} = {noul.format('y2')} THEN 'same' ELSE 'differs' END AS status, round(gap, 6) AS greatest_gap FROM g""",
        "kind_groups": "SELECT CAST((p_size - 1) // 25 AS INTEGER) AS group_no, count(*) AS n, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1",
        "legal_predicates": f"WITH {TYPED} SELECT document_id, src_ord, tgt_ord, relation, p_ord FROM ranked WHERE p_ord <= 4",
        "pairs_cut": f"WITH {TYPED}, n AS (SELECT document_id, count(DISTINCT src_ord * 1000 + tgt_ord) - 4 AS pairs_cut FROM legal GROUP BY document_id) SELECT * FROM n WHERE pairs_cut > 0",
        "signatures": "SELECT * FROM (VALUES ('SUPPLIER', 'NATION', 'LOCATED_IN'), ('NATION', 'REGION', 'PART_OF'), ('SUPPLIER', 'SUPPLIER', 'DEPENDS_ON')) t(src_type, tgt_type, relation)",
        "grouped_kinds": "SELECT CAST(p_partkey AS VARCHAR) AS document_id, 'K' || lpad(CAST(p_size % 40 AS VARCHAR), 2, '0') AS entity_type, 'ACCEPT' AS band, CAST(0.85 AS DOUBLE) AS winner_prob FROM part",
        "event_keys": """SELECT sha256('{' || CASE WHEN props IS NULL THEN '' ELSE '"body":' || CAST(to_json(props) AS VARCHAR) || ',' END || '"contract":"2","model":' || CAST(to_json(event_type) AS VARCHAR) || '}') AS cache_key, count(*) AS n FROM events GROUP BY 1""",
        "event_misses": """WITH k AS (SELECT concat_ws('/', CAST(user_id AS VARCHAR), event_type) AS question_key, value FROM events)
            SELECT DISTINCT question_key FROM k WHERE question_key NOT IN (SELECT question_key FROM k WHERE value > 50)""",
        "segment_scores": f"WITH {LINKS} SELECT {RATIOS} FROM cnt",
        "total_scores": f"WITH {LINKS}, t AS (SELECT doc_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM cnt GROUP BY ROLLUP (doc_id)) SELECT {RATIOS} FROM t",
        "span_scores": """
            WITH r AS (SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS doc_id, l_orderkey * 10 + l_linenumber AS a, l_returnflag AS g, CASE WHEN l_discount > 0.08 THEN 'X' ELSE l_returnflag END AS p, l_partkey AS part, l_tax > 0.06 AS turned FROM lineitem),
            p AS (SELECT DISTINCT doc_id, a, p AS kind FROM r), g AS (SELECT DISTINCT doc_id, a, g AS kind FROM r), s AS (SELECT DISTINCT doc_id, a FROM g), l AS (SELECT DISTINCT doc_id, a, part FROM r),
            up AS (SELECT DISTINCT doc_id, a, part FROM r WHERE NOT turned), dn AS (SELECT DISTINCT doc_id, a, part FROM r WHERE turned),
            b AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, p.a IS NOT NULL AS in_p, g.a IS NOT NULL AS in_g FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.a = g.a AND p.kind = g.kind),
            e AS (SELECT doc_id, count(*) FILTER (in_p AND in_g) AS entity_tp, count(*) FILTER (in_p AND NOT in_g) AS entity_fp, count(*) FILTER (in_g AND NOT in_p) AS entity_fn, count(*) FILTER (in_p AND NOT in_g) AS boundary_only FROM b GROUP BY doc_id),
            c AS (SELECT l.doc_id, up.a IS NOT NULL AS ok, dn.a IS NOT NULL AS back FROM l LEFT JOIN up USING (doc_id, a, part) LEFT JOIN dn USING (doc_id, a, part)),
            x AS (SELECT doc_id, count(*) FILTER (ok) AS link_tp, count(*) FILTER (back) AS link_fp, count(*) FILTER (NOT ok) AS link_fn, count(*) FILTER (back) AS direction_swaps FROM c GROUP BY doc_id)
            SELECT doc_id, entity_tp, entity_fp, entity_fn, link_tp, link_fp, link_fn, boundary_only, direction_swaps FROM e JOIN x USING (doc_id)""",
        "precision_curve": f"WITH {CURVE} SELECT o_orderpriority, rank, threshold, round(coverage, 6) AS coverage, round(prec, 6) AS precision FROM points",
        "fitted_gates": f"""WITH {CURVE}, c AS (SELECT o_orderpriority, arg_max(threshold, rank) FILTER (1 - prec <= 0.6) AS t FROM points GROUP BY o_orderpriority),
            f AS (SELECT o_orderpriority, CASE WHEN t IS NULL THEN 0.7 ELSE greatest(0.5, least(0.95, t)) END AS a FROM c) SELECT o_orderpriority, round(a, 6) AS accept_prob, round(least(0.4, a * 0.5), 6) AS reject_prob FROM f""",
        "latencies": "SELECT event_type, round(avg(ms), 3) AS mean_ms, round(median(ms), 3) AS median_ms, round(sum(ms) / (2 * count(*)), 3) AS ms_per_question FROM (SELECT event_type, round(value, 4) AS ms FROM events) GROUP BY event_type",
        "latest_answers": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC NULLS LAST, model DESC NULLS LAST, body_hash DESC NULLS LAST) AS rn FROM decisions)
            SELECT cache_key, model, body_hash, epoch_us(created_at) AS created_us FROM r WHERE rn = 1""",
        "latest_runs": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY finished_at DESC NULLS LAST, document_id DESC NULLS LAST, model DESC NULLS LAST, ontology_id DESC NULLS LAST) AS rn FROM runs)
            SELECT run_id, document_id, model, ontology_id, epoch_us(finished_at) AS finished_us FROM r WHERE rn = 1""",
        "gold_without_notes": """SELECT DISTINCT document_id FROM label_files WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM documents WHERE text <> '')""",
        "cut_listing": """WITH r AS (SELECT c_nationkey AS document_id, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY -c_acctbal, c_custkey) AS INTEGER) AS place, greatest(0, count(*) OVER (PARTITION BY c_nationkey) - 5) AS more FROM customer)
            SELECT document_id, c_custkey, place, more FROM r WHERE place <= 5""",
    }


