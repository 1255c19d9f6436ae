"""Files and tables the engine reads and keeps: notes, gold labels, token splits, results, answers, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "entities array<struct<name:string,type:string,entity_type:string,start:int,end:int>>, relations array<struct<source:string,target:string,type:string,relation_type:string>>, relationships array<struct<source:string,target:string,type:string,relation_type:string>>"
TOKEN_DOCUMENT = "tokens array<string>, entities array<struct<type:string,start:int,end:int>>, relations array<struct<type:string,head:int,tail:int>>, orig_id bigint"
RESULT = (
    "entities array<struct<name:string,entity_type:string,description:string,importance:double,source_spans:array<string>,source_chunk_ids:array<string>,source_document_id:string,display_name:string>>, "
    "relationships array<struct<source:string,target:string,relation_type:string,description:string,weight:double>>, "
    "review array<struct<kind:string,reason:string,text:string,source:string,target:string,type:string,asked:string,band:string,prob:double,sentence_id:string>>, input_tokens bigint, output_tokens bigint"
)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_notes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(document_id, text) of whole text files; the id is the file's stem."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(_stem(F.col("_metadata.file_name")).alias("document_id"), F.col("value").alias("text"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, entities, relations) of gold JSON files; both spellings of the field names are read."""
    rows = spark.read.schema(GOLD).option("multiLine", True).json(path)
    return gold_shape(rows.withColumn("document_id", _stem(F.col("_metadata.file_name"))))


def gold_shape(rows: DataFrame) -> DataFrame:
    entities = F.transform("entities", lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], e["entity_type"]).alias("type"), e["start"].alias("start"), e["end"].alias("end")))
    links = F.transform(F.coalesce("relations", "relationships"), lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), F.coalesce(r["type"], r["relation_type"]).alias("type")))
    return rows.select("document_id", entities.alias("entities"), links.alias("relations"))


def parse_gold(rows: DataFrame, json_col: str) -> DataFrame:
    """The same from a column of JSON texts; texts that cannot be read give nulls."""
    return gold_shape(rows.select("document_id", F.from_json(json_col, GOLD).alias("g")).select("document_id", "g.*"))


def pair_gold(gold: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, labels without a note)."""
    return gold.join(notes, "document_id"), gold.join(notes.select("document_id"), "document_id", "left_anti")


CONVERTED_DOCUMENT = (
    "id string, text string, entities array<struct<index:int,name:string,type:string,start:int,end:int>>, "
    "relations array<struct<type:string,source:string,target:string,head:int,tail:int>>"
)


def read_token_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Token documents of one split with ids like ``test_0007`` in file order.

    A file is one array of documents; their places in it number them, so files are read side by side and no rows
    are sorted. Ids count within a file.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{_struct(TOKEN_DOCUMENT)}>>")).alias("no", "d"))
    return rows.select(F.concat(F.lit(f"{split}_"), F.lpad(F.col("no").cast("string"), 4, "0")).alias("doc_id"), "d.*")


def read_converted_split(spark: SparkSession, path: str) -> DataFrame:
    """Documents that were converted before: their own ids, texts and character spans."""
    rows = spark.read.schema(CONVERTED_DOCUMENT).option("multiLine", True).json(path)
    return rows.withColumnRenamed("id", "doc_id")


def _struct(ddl: str) -> str:
    """The columns of a DDL as those of a struct."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl).simpleString()[len("struct<") : -1]


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).option("multiLine", True).json(path)


def parse_results(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, entities, relationships, review, ...) from a column of result texts."""
    return rows.select(id_col, F.from_json(json_col, RESULT).alias("r")).select(id_col, "r.*")


def write_statements(statements: DataFrame, path: str) -> None:
    statements.orderBy("document_id", "ord", "statement").select("statement").write.mode("overwrite").text(path)


# kept answers and runs are append-only tables; the latest row of a key counts


def keep(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest_by_key(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, the latest; partial aggregation keeps a hot key from meeting in one task."""
    others = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(F.col(at), *[F.col(c).cast("string") for c in others if c != at]))
    return rows.groupBy(key).agg(newest.alias("r")).select(key, "r.*")


def latest_line(rows: DataFrame, key: str) -> DataFrame:
    """Of JSON lines appended with one key the last; ``line_no`` orders them."""
    return latest_by_key(rows, key, "line_no")


def run_row(spark: SparkSession, run_id: str, document_id: str, model: str, ontology_id: str, started: float, finished: float, stats_json: str, result_json: str) -> DataFrame:
    """One run as a row for ``keep``."""
    row = spark.createDataFrame([(run_id, document_id, model, ontology_id, started, finished, stats_json, result_json)], "run_id string, document_id string, model string, ontology_id string, s double, f double, stats_json string, result_json string")
    return row.select("run_id", "document_id", "model", "ontology_id", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("f").alias("finished_at"), "stats_json", "result_json")
