"""Chat replies that hold a graph as JSON: parsed, grounded in the ontology and placed in their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_name, strip
from .ontology import Ontology

REPLY = (
    "entities array<struct<name:string,type:string,entity_type:string,description:string>>, "
    "relations array<struct<source:string,target:string,type:string,relation_type:string,description:string>>, "
    "relationships array<struct<source:string,target:string,type:string,relation_type:string,description:string>>"
)
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
BRACED = r"(?s)(\{.*\})"


def reply_text(raw: Column) -> Column:
    """The JSON part of a reply: a fenced block, else from the first to the last brace, else the whole."""
    fenced, braced = F.regexp_extract(raw, FENCED, 1), F.regexp_extract(raw, BRACED, 1)
    return F.when(fenced != "", fenced).when(braced != "", braced).otherwise(strip(raw))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(document_id, reply, ok): replies that are no JSON object are kept as not ok."""
    text = reply_text(F.coalesce("content", F.lit("")))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    return replies.select("document_id", F.from_json(text, REPLY).alias("reply"), is_object.alias("ok"))


def ground(parsed: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships): the first entity of each canonical name with a listed kind; links between them.

    Links need a listed relation and two different known ends; they are not deduplicated.
    """
    kinds, links = [k.id for k in ontology.kinds], [x.id for x in ontology.links]
    rows = parsed.where("ok").select("document_id", F.posexplode("reply.entities").alias("at", "e"))
    rows = rows.select("document_id", "at", strip(F.col("e.name")).alias("display_name"), F.upper(F.coalesce("e.type", "e.entity_type", F.lit("OTHER"))).alias("entity_type"), "e.description")
    rows = rows.withColumn("name", canonical_name(F.col("display_name"))).where((F.coalesce("name", F.lit("")) != "") & F.col("entity_type").isin(*kinds))
    first = F.row_number().over(Window.partitionBy("document_id", "name").orderBy("at", "display_name", "entity_type", "description"))
    entities = rows.withColumn("rn", first).where(F.col("rn") == 1).select("document_id", "name", "entity_type", "display_name", F.coalesce("description", "display_name").alias("description"))
    named = F.when(F.size("reply.relationships") > 0, F.col("reply.relationships")).otherwise(F.col("reply.relations"))
    rel = parsed.where("ok").select("document_id", F.posexplode(named).alias("at", "r"))
    rel = rel.select("document_id", "at", canonical_name(F.col("r.source")).alias("source"), canonical_name(F.col("r.target")).alias("target"), F.upper(F.coalesce("r.type", "r.relation_type")).alias("relation_type"), F.coalesce("r.description", F.lit("")).alias("description"))
    rel = rel.where((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")) & F.col("relation_type").isin(*links))
    known = entities.select("document_id", "name")
    rel = rel.join(known.withColumnRenamed("name", "source"), ["document_id", "source"], "left_semi").join(known.withColumnRenamed("name", "target"), ["document_id", "target"], "left_semi")
    return entities, rel


def retry_waits(attempts: int = 4) -> list[float]:
    """Seconds to wait before each further try of a busy host."""
    return [float(2**i) for i in range(attempts - 1)]
