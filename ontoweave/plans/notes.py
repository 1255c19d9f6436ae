"""Queries of the extraction pipeline over notes templated from the star schema, whose links are known joins.

A note says of one supplier where it is located; depending on its balance it also holds a hedged or a
negated sentence. The listed names are the suppliers, nations and regions, so their number grows with the
data and the matcher has to choose its way by their count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_name, link_phrase, review_phrase
from ..operators import assemble, decide, deciders, export, mentions, ontology, parsing
from ..session import cut_lineage, table
from ..streaming import sections
from .pipeline import Extraction, extract

Query = Callable[[SparkSession, str], DataFrame]


def _facts(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


def notes(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, text)."""
    s, n, r = F.col("s_name"), F.col("n_name"), F.col("r_name")
    text = F.concat(
        F.lit("# "), n, F.lit("\n\n**"), s, F.lit("** is located in "), n, F.lit(". "), n, F.lit(" is part of "), r, F.lit("."),
        F.when(F.col("s_acctbal") < 0, F.concat(F.lit("\n\n## Open\n\n"), s, F.lit(" may be located in "), n, F.lit("."))).otherwise(""),
        F.when(F.col("s_acctbal") >= 5000, F.concat(F.lit("\n\n## Wrong\n\n"), s, F.lit(" is not located in "), n, F.lit("."))).otherwise(""))
    return _facts(spark, d).select(F.concat(F.lit("note-"), F.col("s_suppkey").cast("string")).alias("document_id"), text.alias("text"))


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """(name, type, ord) of all listed names."""
    part = lambda t, key, name, kind: table(spark, d, t).select(F.col(name).alias("name"), F.lit(kind).alias("type"), F.col(key).cast("long").alias("ord"))
    return part("supplier", "s_suppkey", "s_name", "SUPPLIER").unionByName(part("nation", "n_nationkey", "n_name", "NATION")).unionByName(part("region", "r_regionkey", "r_name", "REGION"))


def extraction(spark: SparkSession, d: str) -> Extraction:
    return extract(notes(spark, d), ontology.load("trade"), gazetteer(spark, d))


NOTES = """
  facts AS (
    SELECT 'note-' || s_suppkey AS document_id, s_name AS s, n_name AS n, r_name AS r, s_acctbal AS bal
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  said AS (
    SELECT document_id, 0 AS idx, '**' || s || '** is located in ' || n || '.' AS text, s, n, r, bal, length('# ' || n) + 2 AS start_char, n AS path FROM facts
    UNION ALL
    SELECT document_id, 1, n || ' is part of ' || r || '.', s, n, r, bal, length('# ' || n) + 2 + length('**' || s || '** is located in ' || n || '. '), n FROM facts
    UNION ALL
    SELECT document_id, 2, s || CASE WHEN bal < 0 THEN ' may be located in ' ELSE ' is not located in ' END || n || '.', s, n, r, bal,
           length('# ' || n) + 2 + length('**' || s || '** is located in ' || n || '. ' || n || ' is part of ' || r || '.') + length(chr(10) || chr(10) || CASE WHEN bal < 0 THEN '## Open' ELSE '## Wrong' END) + 2,
           n || ' > ' || CASE WHEN bal < 0 THEN 'Open' ELSE 'Wrong' END
    FROM facts WHERE bal < 0 OR bal >= 5000)
"""


def sql_name(x: str) -> str:
    """The canonical name as a SQL expression."""
    words = f"list_filter(regexp_split_to_array(lower(nfc_normalize(regexp_replace(trim({x}), '''s([^\\p{{L}}\\p{{N}}_]|$)', '\\1', 'g'))), '[^0-9a-z]+'), lambda w: w <> '' AND w NOT IN ('the', 'a', 'an'))"
    low = f"lower(nfc_normalize(trim({x})))"
    opaque = f"regexp_matches({low}, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$|^[0-9a-f]{{32,}}$|^[0-9]+$')"
    name = f"upper(array_to_string({words}, '_'))"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {opaque} OR regexp_matches({name}, '^[0-9]+$') THEN '' ELSE {name} END"


def sql_pretty(x: str) -> str:
    """A name as it reads in a sentence, as a SQL expression."""
    titled = f"array_to_string(list_transform(string_split(lower(replace({x}, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return f"CASE WHEN contains({x}, '_') OR (upper({x}) = {x} AND regexp_matches({x}, '[A-Z]') AND length({x}) > 4) THEN {titled} ELSE {x} END"


def note_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = parsing.sentences(notes(spark, d))
    return rows.select("document_id", "sentence_id", "idx", "text", "start_char", "end_char", parsing.heading_context(F.col("heading_path")).alias("heading"))


def note_headings(spark: SparkSession, d: str) -> DataFrame:
    rows = parsing.headings(notes(spark, d))
    return rows.select("document_id", "level", "title", parsing.heading_context(F.col("heading_path")).alias("heading"))


def note_front_matter(spark: SparkSession, d: str) -> DataFrame:
    docs = notes(spark, d).select("document_id", F.concat(F.lit("---\nid: "), "document_id", F.lit("\n---\n"), "text").alias("text"))
    return parsing.strip_front_matter(docs).select("document_id", "body_start", F.length("body").alias("body_length"))


def note_fences(spark: SparkSession, d: str) -> DataFrame:
    docs = notes(spark, d).select("document_id", F.concat(F.lit("```\nx = 1\n```\n"), "text", F.lit("\n\n```sh\nls\n")).alias("text"))
    return parsing.fence_regions(docs)


def note_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = _facts(spark, d).select(
        F.concat(F.lit("note-"), F.col("s_suppkey").cast("string")).alias("document_id"),
        F.concat(F.lit("- "), "s_name", F.lit("\n- "), "n_name", F.lit("\n1. "), "r_name", F.lit("\n> so it is")).alias("text"))
    return parsing.sentences(docs, blocks=True).select("document_id", "idx", "text", "start_char")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return parsing.lines(table(spark, d, "documents").select("document_id", "text")).withColumn("line", F.regexp_replace("line", "\r$", "")).where(F.col("line") != "").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_start").alias("last_start"), F.sum(F.length("line")).alias("n_chars"))


def token_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.split(F.concat_ws(" ", F.lit("Order"), F.col("o_orderkey").cast("string"), F.lit("for"), F.col("o_custkey").cast("string"), F.lit("is"), "o_orderpriority"), " ").alias("tokens"))
    return parsing.token_rows(rows, "o_orderkey", "tokens")


def converted_links(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.split(F.concat_ws(" ", F.lit("Order"), F.col("o_orderkey").cast("string"), F.lit("for"), F.lit("Customer"), F.col("o_custkey").cast("string")), " ")
    entity = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    docs = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("doc_id"), tokens.alias("tokens"), F.array(entity("Ord", 0, 2), entity("Cust", 3, 5)).alias("entities"),
        F.array(F.struct(F.lit("Placed_By").alias("type"), F.lit(0).alias("head"), F.lit(1).alias("tail"))).alias("relations"))
    _, links = parsing.convert_spans(docs, {"Ord": "ORDER", "Cust": "CUSTOMER"}, {"Placed_By": "CREATED_BY"})
    return links.select("doc_id", "type", "source", "target", "head_start", "head_end", "tail_start", "tail_end", "head_type", "tail_type")


def listed_mentions(spark: SparkSession, d: str) -> DataFrame:
    found = mentions.listed_names(parsing.sentences(notes(spark, d)), gazetteer(spark, d))
    return found.select("document_id", "sentence_id", "text", "start_char", "end_char", "source")


def cue_mentions(spark: SparkSession, d: str) -> DataFrame:
    found = mentions.markdown_cues(parsing.sentences(notes(spark, d)))
    return found.select("document_id", "sentence_id", "text", "start_char", "end_char")


def merged_mentions(spark: SparkSession, d: str) -> DataFrame:
    return mentions.propose(parsing.sentences(notes(spark, d)), gazetteer(spark, d)).select("document_id", "sentence_id", "m_ord", "text", "start_char", "source")


def capital_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("document_id", "text")
    return mentions.capital_runs(parsing.sentences(docs)).groupBy(F.col("text").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def name_suggestions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("document_id", "text")
    return mentions.suggest_names(parsing.sentences(docs), gazetteer(spark, d))


def document_sentences(spark: SparkSession, d: str) -> DataFrame:
    return parsing.sentences(table(spark, d, "documents").select("document_id", "text")).select("sentence_id", "text", "start_char", "end_char")


def bounded_pieces(spark: SparkSession, d: str) -> DataFrame:
    return parsing.bounded_pieces(table(spark, d, "documents"), "doc_id", "text", 500).select("doc_id", "part_no", "start_char", "end_char")


def pronoun_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("document_id", F.col("document_id").alias("sentence_id"), "text", F.lit(0).alias("start_char"), F.expr("cast(array() as array<string>)").alias("heading_path"))
    return mentions.pronouns(rows).groupBy(F.lower("text").alias("pronoun")).agg(F.count(F.lit(1)).alias("n"))


def word_occurrences(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(mentions.occurrences(F.col("text"), F.lit("the")))
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", n.alias("n")).where("n > 0")


def note_typing(spark: SparkSession, d: str) -> DataFrame:
    return extraction(spark, d).typed.groupBy("entity_type", "band", "decided_by").agg(F.count(F.lit(1)).alias("n"))


def asked_typing(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that are not listed, typed by asking: a table answers by their balance, unsure of every other one."""
    onto = ontology.load("trade")
    listed = gazetteer(spark, d).where(F.col("type") != "SUPPLIER")
    sents = cut_lineage(parsing.sentences(notes(spark, d)))
    known = table(spark, d, "supplier").select(F.col("s_name").alias("_name"), "s_acctbal", (F.col("s_suppkey") % 2 == 1).alias("unsure"))

    def decider(questions: DataFrame) -> DataFrame:
        rows = questions.join(known, F.col("about.mention") == F.col("_name"))
        p = F.when(F.col("s_acctbal") >= 5000, 0.9).when(F.col("s_acctbal") < 0, 0.1).otherwise(0.5)
        first = F.element_at("options", 1)["label"] == "SUPPLIER"
        label = F.when(first | ~F.col("unsure"), "SUPPLIER").otherwise("NATION")
        sure = F.when(F.col("unsure"), 0.2).otherwise(0.9)
        answer = F.when(F.col("kind") == "noul", deciders.noul_answer(p)).otherwise(deciders.choice_answer(label, F.lit(0.8), F.col("options"), sure))
        return deciders.free(rows.select("question_key", answer.alias("answer")))

    found = mentions.propose(sents, listed)
    typed = decide.type_mentions(found, sents, listed, onto, decide.Gate(rotate_below_confidence=0.5), decider, "table")
    return typed.where(F.col("decided_by") == "model").select("document_id", "text", "entity_type", "band", F.round("winner_prob", 6).alias("winner_prob"), "flipped")


def run_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised runs in templated sentences, without opening words and listed names."""
    n = table(spark, d, "nation")
    text = F.concat(F.lit("On Monday the Bank of "), F.initcap(F.lower(F.replace("n_name", F.lit("_"), F.lit("")))), F.lit(" met Orlo Vane's team in Port Imre."))
    rows = n.select(F.col("n_nationkey").cast("string").alias("document_id"), F.concat(F.col("n_nationkey").cast("string"), F.lit("-s0")).alias("sentence_id"), text.alias("text"), F.lit(0).alias("start_char"), F.expr("cast(array() as array<string>)").alias("heading_path"))
    listed = spark.createDataFrame([("Port Imre", "TOWN", 0)], "name string, type string, ord long")
    return mentions.capital_runs(rows, mentions.listed_names(rows, listed)).select("document_id", "text", "start_char", "end_char")


def piece_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the bounded pieces of every document cover, and whether they are within the bound and follow each other."""
    rows = parsing.bounded_pieces(table(spark, d, "documents"), "doc_id", "text", 500).groupBy("doc_id")
    return rows.agg(F.sum(F.col("end_char") - F.col("start_char")).alias("covered"), F.max("end_char").alias("last"), (F.max(F.length("part")) <= 500).alias("bounded"))


def note_link_decisions(spark: SparkSession, d: str) -> DataFrame:
    return extraction(spark, d).hits.select("document_id", "sentence_id", F.col("src_text").alias("source"), F.col("tgt_text").alias("target"), "asked", "relation_type", "prob", "band")


def note_entities(spark: SparkSession, d: str) -> DataFrame:
    return extraction(spark, d).entities.select("document_id", "name", "entity_type", "display_name", "importance", "source_spans")


def note_relationships(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the links of all notes."""
    return extraction(spark, d).relationships.select("document_id", "source", "target", "relation_type", "weight", "description")


def note_queue(spark: SparkSession, d: str) -> DataFrame:
    return extraction(spark, d).items.select("document_id", "queue", "kind", "source", "target", "type", "asked", "band", "prob")


def note_statistics(spark: SparkSession, d: str) -> DataFrame:
    return extraction(spark, d).statistics()


def note_lineage(spark: SparkSession, d: str) -> DataFrame:
    return extraction(spark, d).lineage().groupBy("what", "decision", "decided_by").agg(F.count(F.lit(1)).alias("n"))


def note_audit(spark: SparkSession, d: str) -> DataFrame:
    """Faults put into the graph of the notes, as the audit finds them."""
    x = extraction(spark, d)
    turned = x.relationships.where(F.col("relation_type") == "PART_OF").select("document_id", F.col("target").alias("source"), F.col("source").alias("target"), "relation_type", (F.col("weight") + 1).alias("weight"), "description")
    return assemble.audit(x.entities, turned, x.sentences, ontology.load("trade"))


def note_forecast(spark: SparkSession, d: str) -> DataFrame:
    listed = gazetteer(spark, d)
    found = mentions.propose(parsing.sentences(notes(spark, d)), listed)
    return decide.forecast(found, listed.where(F.col("type") != "SUPPLIER"))


def note_cypher(spark: SparkSession, d: str) -> DataFrame:
    x = extraction(spark, d)
    return export.cypher(x.entities, x.relationships).select("document_id", "statement")


def note_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    x = extraction(spark, d)
    return export.graph_edges(x.entities, x.relationships, x.items).select("document_id", "source", "target", "type", "label", "sentence", "review")


def note_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return export.graph_nodes(extraction(spark, d).entities, ontology.load("trade"))


def note_web_edges(spark: SparkSession, d: str) -> DataFrame:
    x = extraction(spark, d)
    return export.web_graph(x.entities, x.relationships, x.items, x.sentences, ontology.load("trade"))[1].select("document_id", "source", "target", "relation", "weight", "evidence", "pending")


def note_dashboard(spark: SparkSession, d: str) -> DataFrame:
    x = extraction(spark, d)
    return export.dashboard(x.entities, x.relationships, x.items)


def note_highlights(spark: SparkSession, d: str) -> DataFrame:
    x = extraction(spark, d)
    span = F.struct((F.col("start_char") - F.col("s_start")).alias("start"), (F.col("end_char") - F.col("s_start")).alias("end"), F.col("entity_type").alias("title"), F.lit("#fff").alias("color"))
    texts = x.sentences.select("document_id", "sentence_id", F.col("text").alias("sentence"), F.col("start_char").alias("s_start"))
    rows = x.typed.join(texts, ["document_id", "sentence_id"]).groupBy("sentence_id", "sentence").agg(F.collect_list(span).alias("spans"))
    return rows.select("sentence_id", export.highlight(F.col("sentence"), F.col("spans")).alias("html"))


def note_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = sections.plan_sections(parsing.sentences(notes(spark, d)), 60)
    return rows.groupBy("document_id", "section_no").agg(F.count(F.lit(1)).alias("n_sentences"))


def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all parsed documents of the sentences table."""
    rows = table(spark, d, "sentences").groupBy("sentence_id").agg(F.max_by(F.struct("document_id", "idx", "text", "heading_path"), F.struct("parsed_at", "text")).alias("s")).select("sentence_id", "s.*")
    return sections.plan_sections(rows, 600).groupBy("document_id", "section_no").agg(F.count(F.lit(1)).alias("n_sentences"), F.min("idx").alias("first_idx"))


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_names").select("name").distinct().select("name", canonical_name(F.col("name")).alias("canonical"))


def link_phrases(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    return rows.select("n_nationkey", link_phrase(canonical_name(F.col("n_name")), F.lit("PART_OF"), F.lit("RAG")).alias("phrase"), _ask(F.col("r_name")).alias("ask"))


def _ask(name: Column) -> Column:
    none = F.lit(None).cast("string")
    return review_phrase(F.lit("entity"), name, F.lit("REGION"), none, none, F.lit(0.5))


def degree_capped(spark: SparkSession, d: str) -> DataFrame:
    """The best linked nodes of the graph customer - nation, per market segment."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    edges = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_mktsegment").alias("document_id"), F.col("c_name").alias("source"), F.col("n_name").alias("target"), (F.col("c_acctbal") < 0).alias("pending"))
    ends = edges.select("document_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = ends.select("document_id", "id", F.col("id").alias("label"), F.lit(False).alias("pending"))
    kept, _ = export.cap_graph(nodes, edges)
    return kept.select("document_id", "id", "degree", "place")


QUERIES = (
    note_sentences, note_headings, note_front_matter, note_fences, note_blocks, document_lines, token_spans, converted_links, listed_mentions, cue_mentions, merged_mentions, capital_runs,
    name_suggestions, document_sentences, bounded_pieces, pronoun_counts, word_occurrences, note_typing, asked_typing, run_mentions, piece_cover, note_link_decisions, note_entities, note_relationships, note_queue, note_statistics,
    note_lineage, note_audit, note_forecast, note_cypher, note_graph_edges, note_graph_nodes, note_web_edges, note_dashboard, note_highlights, note_sections, document_sections,
    canonical_names, link_phrases, degree_capped,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


# spans of the names in the templated sentences, relative to the sentence
SPANS = """
  spans AS (
    SELECT document_id, idx, start_char AS pos, s AS name, 2 AS a, 'SUPPLIER' AS kind, bal FROM said WHERE idx = 0
    UNION ALL SELECT document_id, idx, start_char, n, length(text) - length(n) - 1, 'NATION', bal FROM said WHERE idx <> 1
    UNION ALL SELECT document_id, idx, start_char, n, 0, 'NATION', bal FROM said WHERE idx = 1
    UNION ALL SELECT document_id, idx, start_char, r, length(text) - length(r) - 1, 'REGION', bal FROM said WHERE idx = 1
    UNION ALL SELECT document_id, idx, start_char, s, 0, 'SUPPLIER', bal FROM said WHERE idx = 2)
"""
HITS = """
  hits AS (
    SELECT document_id, document_id || '-s' || idx AS sentence_id, idx, text,
           CASE WHEN idx = 1 THEN n ELSE s END AS source, CASE WHEN idx = 1 THEN r ELSE n END AS target,
           CASE WHEN idx = 1 THEN 'PART_OF' ELSE 'LOCATED_IN' END AS asked,
           CASE WHEN idx = 0 THEN 0.93 WHEN idx = 1 THEN 0.94 WHEN bal < 0 THEN 0.5 ELSE 0.04 END AS prob,
           CASE WHEN idx < 2 THEN 'ACCEPT' WHEN bal < 0 THEN 'REVIEW' ELSE 'REJECT' END AS band
    FROM said)
"""


def oracle_sql() -> dict[str, str]:
    s, n, r = sql_name("s"), sql_name("n"), sql_name("r")
    source, target = sql_name("source"), sql_name("target")
    return {
        "note_sentences": f"WITH {NOTES} SELECT document_id, document_id || '-s' || idx AS sentence_id, idx, text, start_char, start_char + length(text) AS end_char, path AS heading FROM said",
        "note_headings": f"""WITH {NOTES}
            SELECT document_id, 1 AS level, n AS title, n AS heading FROM facts
            UNION ALL SELECT document_id, 2, 'Open', n || ' > Open' FROM facts WHERE bal < 0
            UNION ALL SELECT document_id, 2, 'Wrong', n || ' > Wrong' FROM facts WHERE bal >= 5000""",
        "note_front_matter": f"""WITH {NOTES}, sizes AS (SELECT document_id, max(start_char + length(text)) AS n_text FROM said GROUP BY document_id)
            SELECT document_id, length('---' || chr(10) || 'id: ' || document_id || chr(10) || '---' || chr(10)) AS body_start, n_text AS body_length FROM sizes""",
        "note_fences": f"""WITH {NOTES}, sizes AS (SELECT document_id, max(start_char + length(text)) AS n_text FROM said GROUP BY document_id)
            SELECT document_id, 0 AS start_char, 13 AS end_char FROM sizes
            UNION ALL SELECT document_id, 14 + n_text + 2, 14 + n_text + 2 + 9 FROM sizes""",
        "note_blocks": f"""WITH {NOTES}
            SELECT document_id, 0 AS idx, '- ' || s AS text, 0 AS start_char FROM facts
            UNION ALL SELECT document_id, 1, '- ' || n, 3 + length(s) FROM facts
            UNION ALL SELECT document_id, 2, '1.', 6 + length(s) + length(n) FROM facts
            UNION ALL SELECT document_id, 3, r, 9 + length(s) + length(n) FROM facts
            UNION ALL SELECT document_id, 4, '> so it is', 10 + length(s) + length(n) + length(r) FROM facts""",
        "document_lines": """
            WITH head AS (SELECT document_id, text, length(regexp_extract(text, '^---\\r?\\n(?s:.*?)\\r?\\n---\\r?\\n')) AS skip FROM documents WHERE text <> ''),
            cut AS (SELECT document_id, skip, string_split(substr(text, skip + 1), chr(10)) AS parts FROM head WHERE length(text) > skip),
            rows AS (SELECT document_id, skip, unnest(parts) AS line, generate_subscripts(parts, 1) AS no FROM cut),
            placed AS (SELECT document_id, regexp_replace(line, '\\r$', '') AS line, skip + coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM rows)
            SELECT document_id, count(*) AS n_lines, CAST(max(pos) AS INTEGER) AS last_start, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM placed WHERE line <> '' GROUP BY document_id""",
        "token_spans": """
            WITH cut AS (SELECT o_orderkey, string_split('Order ' || o_orderkey || ' for ' || o_custkey || ' is ' || o_orderpriority, ' ') AS parts FROM orders),
            rows AS (SELECT o_orderkey, unnest(parts) AS token, generate_subscripts(parts, 1) - 1 AS token_no FROM cut),
            placed AS (SELECT *, CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY o_orderkey ORDER BY token_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_char FROM rows)
            SELECT o_orderkey, CAST(token_no AS INTEGER) AS token_no, token, start_char, start_char + length(token) AS end_char FROM placed""",
        "converted_links": """
            SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'CREATED_BY' AS type, 'Order ' || o_orderkey AS source, 'Customer ' || o_custkey AS target, 0 AS head_start, length('Order ' || o_orderkey) AS head_end,
                   length('Order ' || o_orderkey || ' for ') AS tail_start, length('Order ' || o_orderkey || ' for Customer ' || o_custkey) AS tail_end, 'ORDER' AS head_type, 'CUSTOMER' AS tail_type FROM orders""",
        "listed_mentions": f"WITH {NOTES}, {SPANS} SELECT document_id, document_id || '-s' || idx AS sentence_id, name AS text, pos + a AS start_char, pos + a + length(name) AS end_char, 'gazetteer' AS source FROM spans",
        "cue_mentions": f"WITH {NOTES} SELECT document_id, document_id || '-s0' AS sentence_id, s AS text, start_char + 2 AS start_char, start_char + 2 + length(s) AS end_char FROM said WHERE idx = 0",
        "merged_mentions": f"WITH {NOTES}, {SPANS} SELECT document_id, document_id || '-s' || idx AS sentence_id, CAST(row_number() OVER (PARTITION BY document_id, idx ORDER BY a) - 1 AS INTEGER) AS m_ord, name AS text, pos + a AS start_char, 'gazetteer' AS source FROM spans",
        "pronoun_counts": """
            WITH words AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM documents WHERE text IS NOT NULL)
            SELECT w AS pronoun, count(*) AS n FROM words
            WHERE w IN ('i','me','my','we','us','our','you','your','he','him','his','she','her','hers','it','its','they','them','their','this','that','these','those') GROUP BY w""",
        "word_occurrences": """
            SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w = 'the')) AS INTEGER) AS n FROM documents
            WHERE text IS NOT NULL AND len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w = 'the')) > 0""",
        "note_typing": f"WITH {NOTES}, {SPANS} SELECT kind AS entity_type, 'ACCEPT' AS band, 'ontology' AS decided_by, count(*) AS n FROM spans GROUP BY kind",
        "asked_typing": """SELECT 'note-' || s_suppkey AS document_id, s_name AS text,
            CASE WHEN s_acctbal < 5000 THEN 'NOT_ENTITY' WHEN s_suppkey % 2 = 1 THEN 'NATION' ELSE 'SUPPLIER' END AS entity_type,
            CASE WHEN s_acctbal < 0 THEN 'REJECT' WHEN s_acctbal < 5000 OR s_suppkey % 2 = 1 THEN 'REVIEW' ELSE 'ACCEPT' END AS band,
            CAST(CASE WHEN s_acctbal < 0 THEN 0.1 WHEN s_acctbal < 5000 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS winner_prob, s_acctbal >= 5000 AND s_suppkey % 2 = 1 AS flipped FROM supplier""",
        "run_mentions": """WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS document_id, array_to_string(list_transform(string_split(lower(replace(n_name, '_', '')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS n FROM nation)
            SELECT document_id, 'Bank of ' || n AS text, 14 AS start_char, 22 + length(n) AS end_char FROM t UNION ALL SELECT document_id, 'Orlo Vane', 27 + length(n), 36 + length(n) FROM t""",
        "piece_cover": "SELECT doc_id, CAST(length(text) AS BIGINT) AS covered, CAST(length(text) AS INTEGER) AS last, true AS bounded FROM documents WHERE text <> ''",
        "note_link_decisions": f"WITH {NOTES}, {HITS} SELECT document_id, sentence_id, source, target, asked, CASE WHEN band = 'ACCEPT' THEN asked ELSE 'NONE' END AS relation_type, CAST(prob AS DOUBLE) AS prob, band FROM hits",
        "note_entities": f"""WITH {NOTES}
            SELECT document_id, {s} AS name, 'SUPPLIER' AS entity_type, s AS display_name, CAST(1 AS DOUBLE) AS importance, s AS source_spans FROM facts
            UNION ALL SELECT document_id, {n}, 'NATION', n, 1, n FROM facts UNION ALL SELECT document_id, {r}, 'REGION', r, 1, r FROM facts""",
        "note_relationships": f"WITH {NOTES}, {HITS} SELECT document_id, {source} AS source, {target} AS target, asked AS relation_type, CAST(prob AS DOUBLE) AS weight, text AS description FROM hits WHERE band = 'ACCEPT'",
        "note_queue": f"WITH {NOTES}, {HITS} SELECT document_id, CASE WHEN band = 'REVIEW' THEN 'review' ELSE 'rejected' END AS queue, 'relation' AS kind, source, target, 'NONE' AS type, asked, band, CAST(prob AS DOUBLE) AS prob FROM hits WHERE band <> 'ACCEPT'",
        "note_statistics": f"""WITH {NOTES}
            SELECT document_id, count(*) AS sentences, 2 * count(*) AS mentions_proposed, CAST(0 AS BIGINT) AS mentions_skipped, 2 * count(*) AS mentions_typed, 2 * count(*) AS mentions_accepted, count(*) AS predicates_asked,
                   count(*) FILTER (idx < 2) AS links_accepted, CAST(0 AS BIGINT) AS pairs_truncated, CAST(3 AS BIGINT) AS entities, CAST(2 AS BIGINT) AS relationships FROM said GROUP BY document_id""",
        "note_lineage": f"""WITH {NOTES}, {SPANS}, {HITS}
            SELECT 'entity' AS what, kind AS decision, 'ontology' AS decided_by, count(*) AS n FROM spans GROUP BY kind
            UNION ALL SELECT 'relation', asked, 'model', count(*) FROM hits WHERE band = 'ACCEPT' GROUP BY asked""",
        "note_audit": f"""WITH {NOTES}, bad AS (SELECT document_id, {r} || ' PART_OF ' || {n} AS subject FROM facts)
            SELECT document_id, 'weight within 0 and 1' AS rule, subject FROM bad UNION ALL SELECT document_id, 'signature is legal', subject FROM bad""",
        "note_forecast": f"""WITH {NOTES}, per AS (SELECT document_id, count(*) AS n_s, count(*) FILTER (idx <> 1) AS unknown FROM said GROUP BY document_id)
            SELECT document_id, unknown AS unknown_names, CAST(2 AS BIGINT) AS typing_calls, 2 * n_s AS link_pairs, CAST(3 AS BIGINT) AS estimated_calls FROM per""",
        "note_cypher": f"""WITH {NOTES}, {HITS}, names AS (SELECT document_id, s AS x, 'SUPPLIER' AS kind FROM facts UNION ALL SELECT document_id, n, 'NATION' FROM facts UNION ALL SELECT document_id, r, 'REGION' FROM facts)
            SELECT document_id, 'MERGE (n:Node {{id: "' || {sql_name('x')} || '"}}) SET n.entity_type = "' || kind || '", n.description = "' || x || '";' AS statement FROM names
            UNION ALL SELECT document_id, 'MATCH (a:Node {{id: "' || {source} || '"}}), (b:Node {{id: "' || {target} || '"}}) MERGE (a)-[e:EDGE {{relation_type: "' || asked || '"}}]->(b) SET e.description = "' || text || '";' FROM hits WHERE band = 'ACCEPT'""",
        "note_web_edges": f"""WITH {NOTES}, {HITS} SELECT document_id, {source} AS source, {target} AS target, asked AS relation, CAST(prob AS DOUBLE) AS weight, text AS evidence, band = 'REVIEW' AS pending FROM hits WHERE band <> 'REJECT'""",
        "note_graph_nodes": f"""WITH {NOTES}
            SELECT document_id, {s} AS id, s AS label, 'SUPPLIER' AS type, 'supplier' AS kind, '#7dd3fc' AS color FROM facts
            UNION ALL SELECT document_id, {n}, n, 'NATION', 'nation', '#fda4af' FROM facts UNION ALL SELECT document_id, {r}, r, 'REGION', 'region', '#c4b5fd' FROM facts""",
        "note_dashboard": f"""WITH {NOTES} SELECT document_id, CAST(3 AS BIGINT) AS names_kept, CAST(2 AS BIGINT) AS links_kept, CAST(CASE WHEN bal < 0 THEN 1 ELSE 0 END AS BIGINT) AS in_review, CAST(0 AS BIGINT) AS names_dropped,
            CAST(CASE WHEN bal >= 5000 THEN 1 ELSE 0 END AS BIGINT) AS links_dropped FROM facts""",
        "note_highlights": f"""WITH {NOTES}, mk AS (SELECT document_id, idx, text, bal, '<mark style="background:#fff" title="SUPPLIER">' || s || '</mark>' AS ms, '<mark style="background:#fff" title="NATION">' || n || '</mark>' AS mn, '<mark style="background:#fff" title="REGION">' || r || '</mark>' AS mr FROM said)
            SELECT document_id || '-s' || idx AS sentence_id, CASE WHEN idx = 0 THEN '**' || ms || '** is located in ' || mn || '.' WHEN idx = 1 THEN mn || ' is part of ' || mr || '.' ELSE ms || CASE WHEN bal < 0 THEN ' may be' ELSE ' is not' END || ' located in ' || mn || '.' END AS html FROM mk""",
        "note_graph_edges": f"""WITH {NOTES}, {HITS}
            SELECT document_id, {source} AS source, {target} AS target, asked AS type, lower(replace(asked, '_', ' ')) AS label,
                   {sql_pretty('source')} || CASE WHEN asked = 'PART_OF' THEN ' is part of ' ELSE ' is located in ' END || {sql_pretty('target')} || '.' AS sentence, false AS review FROM hits WHERE band = 'ACCEPT'
            UNION ALL SELECT document_id, source, target, 'NONE', 'none', 'Check whether any real link holds from ' || {sql_pretty('source')} || ' to ' || {sql_pretty('target')} || '. The model put this at 50%.', true FROM hits WHERE band = 'REVIEW'""",
        "note_sections": f"""WITH {NOTES}, n AS (SELECT document_id, max(CASE WHEN idx = 0 THEN strlen(text) END) AS a, max(CASE WHEN idx = 1 THEN strlen(text) END) AS b, count(*) = 3 AS third FROM said GROUP BY document_id),
            p AS (SELECT document_id, a >= 60 AS cut, CASE WHEN a >= 60 THEN b ELSE a + b END AS size, third FROM n),
            rows_ AS (SELECT document_id, 0 AS no FROM p UNION ALL SELECT document_id, cut::INT FROM p UNION ALL SELECT document_id, cut::INT + (size * 2 >= 60)::INT FROM p WHERE third)
            SELECT document_id, CAST(no AS INTEGER) AS section_no, count(*) AS n_sentences FROM rows_ GROUP BY document_id, no""",
        "link_phrases": f"""SELECT n_nationkey, {sql_pretty(sql_name('n_name'))} || ' is part of RAG.' AS phrase, 'Check whether “' || r_name || '” is a region. The model put this at 50%.' AS ask FROM nation JOIN region ON n_regionkey = r_regionkey""",
        "canonical_names": f"SELECT DISTINCT name, {sql_name('name')} AS canonical FROM gold_names",
        "degree_capped": """
            WITH edges AS (SELECT c_mktsegment AS document_id, c_name AS source, n_name AS target, CASE WHEN c_acctbal < 0 THEN 0.4 ELSE 1.0 END AS w FROM customer JOIN nation ON c_nationkey = n_nationkey),
            ends AS (SELECT document_id, source AS id, w FROM edges UNION ALL SELECT document_id, target, w FROM edges),
            deg AS (SELECT document_id, id, round(CAST(sum(w) AS DOUBLE), 6) AS degree FROM ends GROUP BY document_id, id),
            ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY degree DESC, id) AS INTEGER) AS place FROM deg)
            SELECT document_id, id, degree, place FROM ranked WHERE place <= 80""",
    }
