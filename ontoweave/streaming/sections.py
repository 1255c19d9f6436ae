"""Reading documents section by section: planning, limits, previews, and a stream of sections.

A section is a micro-batch: it is extracted and its decisions appended under the batch's own id, so that a
failed or repeated batch replaces what it wrote and never counts twice; a snapshot re-assembles all decisions
appended so far. Moving a cut-off re-bands kept answers and asks nothing again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assemble, export
from ..sources import files

SECTION_CHARS = 3000


def plan_sections(sentences: DataFrame, target_chars: int = SECTION_CHARS) -> DataFrame:
    """Adds section_no: a section closes when it is full, or half full where a new heading begins.

    The size restarts with each section, so this is a fold over a document's sentence lengths in order; the
    texts stay out of it.
    """
    target = max(target_chars, 1)
    step = F.struct("idx", F.octet_length("text").alias("size"), F.concat_ws("\u0001", "heading_path").alias("path"))
    per = sentences.groupBy("document_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    start = F.struct(F.lit(0).alias("no"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("path"), F.expr("cast(array() as array<struct<idx:int,no:int>>)").alias("out"))

    def fold(acc: Column, s: Column) -> Column:
        new_heading = acc["path"].isNotNull() & (acc["path"] != s["path"]) & (acc["size"] > 0)
        closes = (acc["size"] > 0) & ((acc["size"] >= target) | (new_heading & (acc["size"] * 2 >= target)))
        no = (acc["no"] + closes.cast("int")).cast("int")
        return F.struct(no.alias("no"), F.when(closes, s["size"]).otherwise(acc["size"] + s["size"]).alias("size"), s["path"].alias("path"),
                        F.concat(acc["out"], F.array(F.struct(s["idx"].cast("int").alias("idx"), no.alias("no")))).alias("out"))

    placed = per.select("document_id", F.explode(F.aggregate("steps", start, fold)["out"]).alias("p")).select("document_id", "p.idx", F.col("p.no").alias("section_no"))
    return sentences.join(placed, ["document_id", "idx"])


def limit_sections(sectioned: DataFrame, n: int) -> DataFrame:
    """The first max(n, 1) sections of each document: the feature of reading only a part."""
    return sectioned.where(F.col("section_no") < max(n, 1))


def preview(sections: Column, budget_calls: Column, estimated_calls: Column) -> Column:
    """How many sections a call budget affords, at least one."""
    return F.greatest(F.lit(1), F.least(sections, F.floor(sections * budget_calls / F.greatest(estimated_calls, F.lit(1))))).cast("int")


def progress(sectioned: DataFrame, done: DataFrame) -> DataFrame:
    """(document_id, sections, sections_done, sentences, sentences_done); ``done`` has document_id and section_no."""
    per = sectioned.groupBy("document_id", "section_no").agg(F.count(F.lit(1)).alias("n"))
    mark = done.select("document_id", "section_no").distinct().withColumn("read", F.lit(1))
    rows = per.join(mark, ["document_id", "section_no"], "left")
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.coalesce("read", F.lit(0))).alias("sections_done"), F.sum("n").alias("sentences"), F.sum(F.when(F.col("read") == 1, F.col("n")).otherwise(0)).alias("sentences_done"))


class SectionStream:
    """Sections as a file stream: each batch's decisions go to ``<out>/batch_id=<n>``, written over on a retry."""

    def __init__(self, spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, extract: Callable[[DataFrame], dict[str, DataFrame]]):
        self.spark, self.source, self.schema, self.out, self.checkpoint, self.extract = spark, source, schema, out, checkpoint, extract

    def _batch(self, rows: DataFrame, batch_id: int) -> None:
        for name, frame in self.extract(rows).items():
            frame.write.mode("overwrite").parquet(f"{self.out}/{name}/batch_id={batch_id}")

    def run(self, files_per_batch: int = 1) -> None:
        """Reads all files that are there, ``files_per_batch`` a batch, and stops."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_batch).parquet(self.source)
        query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def read(self, name: str) -> DataFrame:
        """Everything of one kind that has been decided so far."""
        return self.spark.read.parquet(f"{self.out}/{name}")

    def snapshot(self) -> dict[str, DataFrame]:
        """entities, relationships and items of all that has been read so far, assembled anew from the kept decisions.

        Decisions are ordered by their batch and then within it, so an interrupted stream gives the same graph as one
        that ran through.
        """
        order = Window.partitionBy("document_id").orderBy("batch_id", "ord")
        numbered = lambda name, c: self.read(name).withColumnRenamed(c, "ord").withColumn(c, F.row_number().over(order) - 1).drop("ord", "batch_id")
        routed = assemble.route_mentions(numbered("typed", "d_ord"))
        entities = assemble.merge_entities(routed)
        links = assemble.route_links(numbered("hits", "h_ord"), entities)
        return {"entities": entities, "relationships": assemble.merge_links(links), "items": assemble.queue(routed, links)}

    def finish(self, ledger: str, run_id: str, model: str, ontology_id: str, started: float) -> dict[str, DataFrame]:
        """The last snapshot; only now the run is written to the ledger, one row for each document."""
        graph = self.snapshot()
        results = export.result_json(graph["entities"], graph["relationships"], graph["items"])
        stats = export.dashboard(graph["entities"], graph["relationships"], graph["items"])
        stats = stats.select("document_id", F.to_json(F.struct(*[c for c in stats.columns if c != "document_id"])).alias("stats_json"))
        rows = results.join(stats, "document_id", "left").select(
            F.lit(run_id).alias("run_id"), "document_id", F.lit(model).alias("model"), F.lit(ontology_id).alias("ontology_id"), F.timestamp_seconds(F.lit(started)).alias("started_at"), F.current_timestamp().alias("finished_at"), "stats_json", "result_json")
        files.keep(rows, ledger)
        return graph
