"""Queries over the exported JSON records: flat child tables and schema drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, nested
from ..session import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]


def _run_nodes(spark: SparkSession, d: str, with_fields: bool) -> DataFrame:
    runs = table(spark, d, "runs")
    arrays = nested.array_schema(runs, "result_json")
    return nested.explode_arrays(nested.latest_json(runs, "run_id", "result_json", "finished_at"), arrays, with_fields=with_fields)


def _decision_nodes(spark: SparkSession, d: str, with_fields: bool) -> DataFrame:
    """Decisions have no times that tell copies of a key apart as records do: every distinct text counts."""
    rows = table(spark, d, "decisions").select(F.col("cache_key").alias("record_id"), F.col("response_json").alias("body")).distinct()
    arrays = nested.array_schema(rows, "body", drift.MAP_FIELDS) if with_fields else frozenset()
    return nested.explode_arrays(rows, arrays, drift.ENTRIES, drift.MAP_FIELDS, with_fields)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    columns = ("record_id", "child", "parent")
    runs = _run_nodes(spark, d, with_fields=False).where(F.col("place") != "").select(*columns)
    answers = _decision_nodes(spark, d, with_fields=False).where(F.col("place") == "answers.*").select(*columns)
    # child paths are unique within a run; only answers can repeat, by copies of a cache key
    return runs.unionByName(answers.distinct())


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the runs' entities: keys and a typed column for each field of the merged schema."""
    nodes = cut_lineage(_run_nodes(spark, d, True))
    return nested.child_table(nodes, "entities[]", nested.field_schema(nodes)["entities[]"])


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the runs' entities as a row, with its kind."""
    rows = _run_nodes(spark, d, True).where(F.col("place") == "entities[]").select("record_id", "child", "kinds", F.explode("fields").alias("field", "value"))
    return rows.select("record_id", "child", "field", F.col("kinds")[F.col("field")].alias("kind"), "value")


def p2_roots(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each table has, roots included, and how many of them have no parent row (none but roots)."""
    nodes = nested.with_keys(_run_nodes(spark, d, False))
    parents = nodes.select(F.col("row_key").alias("parent_key"), F.lit(1).alias("known"))
    rows = nodes.join(parents, "parent_key", "left")
    return rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("known").isNull(), 1)).alias("without_parent"))


def p2_votes(spark: SparkSession, d: str) -> DataFrame:
    """Three levels down: votes joined to the alternatives and mentions they belong to."""
    nodes = cut_lineage(nested.with_keys(_run_nodes(spark, d, True)))
    votes = nodes.where(F.col("place") == "mentions[].alternatives[].votes[]").select(
        "record_id", "parent_key", "child", F.col("fields")["voter"].alias("voter"), F.col("fields")["noul"].try_cast("double").alias("noul"))
    alternatives = nodes.where(F.col("place") == "mentions[].alternatives[]").select(
        F.col("row_key").alias("alternative_key"), F.col("fields")["entity_type"].alias("entity_type"))
    return votes.join(alternatives, votes.parent_key == alternatives.alternative_key).select("record_id", "child", "entity_type", "voter", "noul")


def p2_answers(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the decisions' answers."""
    nodes = _decision_nodes(spark, d, True).where(F.col("place") == "answers.*")
    field = lambda f: F.col("fields")[f]
    return nodes.select("record_id", "child", field("type").alias("type"), field("choice").alias("choice"), field("noul").try_cast("double").alias("noul"), field("confidence").try_cast("double").alias("confidence"), field("probabilities").alias("probabilities"))


# the tables that are exported as files, and the column that holds the JSON
FEEDS = (("label_files", "body", ("file_name", "line_no")), ("decisions", "response_json", ("cache_key", "created_at")), ("runs", "result_json", ("run_id", "finished_at")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    reports = [drift.drift_report(table(spark, d, t), c) for t, c, _ in FEEDS]
    return reports[0].unionByName(reports[1]).unionByName(reports[2]).select("feed", "file_no", "change", "field", "new_field")


def _unified(spark: SparkSession, d: str, which: int) -> DataFrame:
    name, column, keys = FEEDS[which]
    rows = table(spark, d, name)
    return drift.unified(rows, column, cut_lineage(drift.drift_report(rows, column)), list(keys))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """All three tables, each consistent in itself: every field of every element under its newest name."""
    out = None
    for which, (name, _, _) in enumerate(FEEDS):
        part = drift.values(_unified(spark, d, which)).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of the label files' entities."""
    return drift.element_table(cut_lineage(_unified(spark, d, 0)), "entities[]")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_entities, p2_values, p2_roots, p2_votes, p2_answers, p5_found, p5_unified, p5_entities)}


def _opened(x: str) -> str:
    """A JSON value in SQL, a string that itself is JSON replaced by what it holds."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND substr({x} ->> '$', 1, 1) IN ('[', '{{') AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END"


def _elements(name: str, source: str, keys: str, value: str, path: str) -> str:
    """(keys, child, el): the objects that are elements of a JSON value; a lone object is element 0."""
    return f"""
      {name}_o AS (SELECT {keys}, {path} AS above, {_opened(value)} AS o FROM {source}),
      {name}_l AS (SELECT * EXCLUDE (o), CASE json_type(o) WHEN 'OBJECT' THEN [o] WHEN 'ARRAY' THEN CAST(o AS JSON[]) ELSE CAST([] AS JSON[]) END AS l FROM {name}_o),
      {name}_u AS (SELECT * EXCLUDE (l, above), above || '[' || (generate_subscripts(l, 1) - 1) || ']' AS child, unnest(l) AS raw FROM {name}_l),
      {name} AS (SELECT * EXCLUDE (raw), {_opened('raw')} AS el FROM {name}_u WHERE json_type({_opened('raw')}) = 'OBJECT')"""


RUNS = """
      last AS (SELECT run_id, result_json, row_number() OVER (PARTITION BY run_id ORDER BY finished_at DESC NULLS LAST, result_json DESC NULLS LAST) AS rn FROM runs),
      body AS (SELECT run_id AS record_id, CAST(result_json AS JSON) AS j FROM last WHERE rn = 1 AND json_valid(result_json) AND json_type(result_json) = 'OBJECT')"""
KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 's' WHEN 'BIGINT' THEN 'i' WHEN 'UBIGINT' THEN 'i' WHEN 'HUGEINT' THEN 'i' WHEN 'DOUBLE' THEN 'n' WHEN 'BOOLEAN' THEN 'b' WHEN 'ARRAY' THEN 'a' WHEN 'OBJECT' THEN 'o' ELSE 'z' END"


def oracle_sql() -> dict[str, str]:
    entities = _elements("entity", "body", "record_id", "json_extract(j, '$.entities')", "'entities'")
    mentions = _elements("mention", "body", "record_id", "json_extract(j, '$.mentions')", "'mentions'")
    alternatives = _elements("alternative", "mention", "record_id", "json_extract(el, '$.alternatives')", "child || '.alternatives'")
    votes = _elements("vote", "alternative", "record_id, el ->> '$.entity_type' AS entity_type", "json_extract(el, '$.votes')", "child || '.votes'")
    kind = KIND.format("v")
    return {
        "p2_values": f"""
            WITH {RUNS}, {entities},
            k AS (SELECT record_id, child, el, unnest(json_keys(el)) AS field FROM entity),
            f AS (SELECT record_id, child, field, json_extract(el, '$."' || field || '"') AS v FROM k)
            SELECT record_id, child, field, {kind} AS kind, CASE {kind} WHEN 's' THEN v ->> '$' WHEN 'z' THEN NULL ELSE CAST(v AS VARCHAR) END AS value FROM f""",
        "p2_votes": f"""
            WITH {RUNS}, {mentions}, {alternatives}, {votes}
            SELECT record_id, child, entity_type, el ->> '$.voter' AS voter, TRY_CAST(el ->> '$.noul' AS DOUBLE) AS noul FROM vote""",
        "p2_answers": f"""
            WITH body AS (SELECT DISTINCT cache_key AS record_id, response_json FROM decisions WHERE json_valid(response_json) AND json_type(response_json) = 'OBJECT'),
            a AS (SELECT record_id, {_opened("json_extract(response_json, '$.answers')")} AS answers FROM body),
            k AS (SELECT record_id, answers, unnest(json_keys(answers)) AS key FROM a WHERE json_type(answers) = 'OBJECT'),
            e AS (SELECT record_id, 'answers.' || key AS child, json_extract(answers, '$."' || key || '"') AS el FROM k),
            f AS (SELECT record_id, child, {", ".join(f"json_extract(el, '$.{x}') AS {x}" for x in ("type", "choice", "noul", "confidence", "probabilities"))} FROM e)
            SELECT record_id, child, {", ".join(f"CASE WHEN json_type({x}) NOT IN ('OBJECT', 'NULL') THEN {x} ->> '$' END AS {x}" for x in ("type", "choice"))},
                   {", ".join(f"TRY_CAST({x} ->> '$' AS DOUBLE) AS {x}" for x in ("noul", "confidence"))}, CASE WHEN json_type(probabilities) <> 'NULL' THEN CAST(probabilities AS VARCHAR) END AS probabilities FROM f""",
    }
