"""The registry, the smoke query, sources, sections as a stream, exports and commands."""

from __future__ import annotations

import ast
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ontoweave import cli
from ontoweave.operators import export, ontology, parsing
from ontoweave.operators.ontology import Kind, Link, Ontology
from ontoweave.plans import benchmark, registry
from ontoweave.plans.pipeline import extract
from ontoweave.sources import files
from ontoweave.streaming import sections

ROOT = Path(__file__).resolve().parent.parent
NOTE = "# T\n\nAda Byron works for Acme. Acme is headquartered in Rome. Ada Byron might have founded Zeta.\n"
ONTO = ontology.from_dict({
    "id": "t", "types": [{"id": "PERSON", "description": "p"}, {"id": "COMPANY", "description": "c"}, {"id": "PLACE", "description": "l"}],
    "relations": [{"id": "WORKS_FOR", "description": "w", "domain": ["PERSON"], "range": ["COMPANY"]}, {"id": "FOUNDED", "description": "f", "domain": ["PERSON"], "range": ["COMPANY"]}, {"id": "HEADQUARTERED_IN", "description": "h", "domain": ["COMPANY"], "range": ["PLACE"]}],
    "gazetteer": {"Ada Byron": "PERSON", "Acme": "COMPANY", "Zeta": "COMPANY", "Rome": "PLACE"},
})


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def test_registry_is_consistent():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_nothing_outside_imports_the_llm_subpackage():
    for path in (ROOT / "ontoweave").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_flagship(spark, smoke_dir):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["document_id", "source"]


def test_notes_gold_and_results(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "l").mkdir()
    (tmp_path / "n" / "a.md").write_text(NOTE)
    (tmp_path / "l" / "a.json").write_text('{"entities":[{"name":"Acme","entity_type":"COMPANY"}],"relationships":[{"source":"Ada Byron","target":"Acme","type":"WORKS_FOR"}]}')
    (tmp_path / "l" / "b.json").write_text('{"entities":[],"relations":[]}')
    gold, alone = files.pair_gold(files.read_gold(spark, str(tmp_path / "l")), files.read_notes(spark, str(tmp_path / "n")))
    row = gold.first()
    assert row.document_id == "a" and row.text == NOTE and row.entities[0].type == "COMPANY" and row.relations[0].source == "Ada Byron"
    assert [r.document_id for r in alone.collect()] == ["b"]


def test_kept_tables(spark, tmp_path):
    row = files.run_row(spark, "r", "d", "m", "o", 1.0, 2.5, "{}", "{}")
    for _ in range(2):
        files.keep(row, str(tmp_path / "runs"))
    kept = spark.read.parquet(str(tmp_path / "runs"))
    assert kept.count() == 2 and files.latest_by_key(kept, "run_id", "finished_at").count() == 1
    lines = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "id string, content string, line_no int")
    assert files.latest_line(lines, "id").first().content == "y"
    assert files.latest_by_key(lines.limit(0), "id", "line_no").count() == 0


def test_token_split(spark, tmp_path):
    doc = {"tokens": ["Jo", "in", "Rome"], "entities": [{"type": "Peop", "start": 0, "end": 1}], "relations": [], "orig_id": 7}
    (tmp_path / "t.json").write_text(json.dumps([doc, doc]))
    ids = [r.doc_id for r in files.read_token_split(spark, str(tmp_path / "t.json"), "test").collect()]
    assert sorted(ids) == ["test_0000", "test_0001"]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "c1", "text": "Jo in Rome", "entities": [{"index": 0, "name": "Jo", "type": "PERSON", "start": 0, "end": 2}], "relations": []}]))
    assert [(r.doc_id, r.entities[0].name) for r in files.read_converted_split(spark, str(tmp_path / "c.json")).collect()] == [("c1", "Jo")]


TOWNS = Ontology("towns", (Kind("PERSON", "A person."), Kind("LOCATION", "A place.")), (Link("LIVES_IN", "Where one lives.", ("PERSON",), ("LOCATION",)),), {"Rome": "LOCATION", "Jo Alba": "PERSON", "Oslo": "LOCATION"})
MAPS = ({"Peop": "PERSON", "Loc": "LOCATION"}, {"Live_In": "LIVES_IN"})
TOKENS = "doc_id string, tokens array<string>, entities array<struct<type:string,start:int,end:int>>, relations array<struct<type:string,head:int,tail:int>>"


def test_a_split_is_extracted_and_scored(spark):
    rows = [
        ("t_0", "Jo Alba lives in Rome .".split(), [("Peop", 0, 2), ("Loc", 4, 5)], [("Live_In", 0, 1)]),
        ("t_1", "In Rome one lives in Jo Alba .".split(), [("Loc", 1, 2)], []),
        ("t_2", "Nothing here .".split(), [], []),
        ("t_3", "Jo Alba never lives in Oslo .".split(), [("Loc", 0, 2), ("Loc", 5, 6)], []),
    ]
    scores = benchmark.run_split(spark.createDataFrame(rows, TOKENS), TOWNS, *MAPS)
    per = {r.doc_id: (r.entity_tp, r.entity_fp, r.entity_fn, r.link_tp, r.link_fp, r.link_fn, r.boundary_only) for r in scores.documents.collect()}
    assert per["t_0"] == (2, 0, 0, 1, 0, 0, 0) and per["t_2"] == (0,) * 7 and per["t_3"] == (1, 1, 1, 0, 0, 0, 1)
    total = {r.what: (r.tp, r.fp, r.fn, r.n_docs, r.boundary_only) for r in scores.summary.collect()}
    assert total["entity"] == tuple(sum(v[i] for v in per.values()) for i in (0, 1, 2)) + (4, 1) and total["link"][0] == 1
    one = benchmark.run_split(spark.createDataFrame(rows, TOKENS), TOWNS, *MAPS, limit=1)
    assert [r.doc_id for r in one.documents.collect()] == ["t_0"]


@pytest.mark.parametrize(("entities", "relations", "match"), [
    ([("Peop", 0, 9)], [], "bad token span"), ([("Peop", 1, 1)], [], "bad token span"), ([("Odd", 0, 1)], [], "unknown kind Odd"), ([("Peop", 0, 1), ("Loc", 1, 2)], [("Odd", 0, 1)], "unknown link Odd"), ([("Peop", 0, 1), ("Loc", 1, 2)], [("Live_In", 1, 0)], "no legal link"),
])
def test_bad_token_documents_raise(spark, entities, relations, match):
    rows = spark.createDataFrame([("d", ["Jo", "Rome"], entities, relations)], TOKENS)
    with pytest.raises(Exception, match=match):
        for frame in parsing.convert_spans(rows, *MAPS, TOWNS):
            frame.collect()


def test_notes_are_scored_in_groups(spark):
    notes = docs(spark, NOTE, "Jo Alba lives in Rome.", "no label")
    schema = "document_id string, entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,type:string>>"
    gold = spark.createDataFrame([("d0", [("Ada Byron", "PERSON")], []), ("d1", [("Jo Alba", "PERSON"), ("Rome", "LOCATION"), ("Oslo", "LOCATION")], [("Jo Alba", "Rome", "LIVES_IN")]), ("gone", [("x", "y")], [])], schema)
    scores = benchmark.score_notes(notes, gold, {"main": (ONTO, None), "towns": (TOWNS, ["d1"])})
    got = {(r.what, r.group): (r.tp, r.fp, r.fn) for r in scores.summary.collect()}
    assert got["entity", "towns"] == (2, 0, 1) and got["relation", "towns"] == (1, 0, 0) and got["entity", "main"] == (1, 3, 0) and got["entity", None] == (3, 3, 1)
    assert scores.seconds > 0 and set(scores.documents.toPandas().document_id) == {"d0", "d1"}


def plan_loop(sizes, paths, target):
    out, no, size = [], 0, 0
    for i, (s, p) in enumerate(zip(sizes, paths)):
        new = i > 0 and p != paths[i - 1]
        if size > 0 and (size >= target or new and size * 2 >= target):
            no, size = no + 1, 0
        size += s
        out.append(no)
    return out


@pytest.mark.parametrize("target", [1, 10, 25, 1000])
def test_sections_equal_the_loop(spark, target):
    sizes, paths = [5, 9, 3, 30, 1, 1, 8, 2], ["a", "a", "b", "b", "b", "c", "c", "d"]
    rows = spark.createDataFrame([("d", i, "x" * s, [p]) for i, (s, p) in enumerate(zip(sizes, paths))], "document_id string, idx int, text string, heading_path array<string>")
    got = [r.section_no for r in sections.plan_sections(rows, target).orderBy("idx").collect()]
    # a heading change counts within a section only
    want, no, size, last = [], 0, 0, None
    for s, p in zip(sizes, paths):
        if size > 0 and (size >= target or last != p and size * 2 >= target):
            no, size = no + 1, 0
        want.append(no)
        size, last = size + s, p
    assert got == want == plan_loop(sizes, paths, target)
    assert sections.limit_sections(sections.plan_sections(rows, target), 0).select("section_no").distinct().count() == 1


def test_progress_and_preview(spark):
    rows = spark.createDataFrame([("d", 0, 0), ("d", 1, 0), ("d", 2, 1)], "document_id string, idx int, section_no int")
    p = sections.progress(rows, rows.where("section_no = 0")).first()
    assert (p.sections, p.sections_done, p.sentences, p.sentences_done) == (2, 1, 3, 2)
    row = spark.createDataFrame([(10, 5, 20)], "s int, b int, e int").select(sections.preview(F.col("s"), F.col("b"), F.col("e")).alias("n")).first()
    assert row.n == 2


def test_a_stream_of_sections_gives_the_graph_of_one_shot(spark, tmp_path):
    texts = docs(spark, NOTE, NOTE.replace("works for", "never works for"))
    whole = {(r.document_id, r.source, r.relation_type, r.target) for r in extract(texts, ONTO).relationships.collect()}
    for i, row in enumerate(texts.collect()):
        spark.createDataFrame([row], texts.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def read(rows):
        x = extract(rows, ONTO)
        return {"typed": x.typed, "hits": x.hits}

    stream = sections.SectionStream(spark, str(tmp_path / "in"), "document_id string, text string", str(tmp_path / "out"), str(tmp_path / "cp"), read)
    stream.run()
    stream.run()  # nothing new: nothing is counted twice
    got = {(r.document_id, r.source, r.relation_type, r.target) for r in stream.snapshot()["relationships"].collect()}
    assert got == whole and ("d0", "ADA_BYRON", "WORKS_FOR", "ACME") in got
    graph = stream.finish(str(tmp_path / "runs"), "r1", "rules", "t", 0.0)
    assert graph["items"].where("queue = 'review'").count() == 2
    runs = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert {r.document_id for r in runs} == {"d0", "d1"} and all(json.loads(r.result_json)["entities"] and json.loads(r.stats_json)["names_kept"] for r in runs)


def test_exports(spark):
    x = extract(docs(spark, NOTE), ONTO)
    statements = [r.statement for r in export.cypher(x.entities, x.relationships).orderBy("ord").collect()]
    assert sum(s.startswith("MERGE") for s in statements) == 4 and sum(s.startswith("MATCH") for s in statements) == 2
    nodes, edges = export.web_graph(x.entities, x.relationships, x.items, x.sentences, ONTO)
    assert nodes.count() == 4 and sorted(r.pending for r in edges.collect()) == [False, False, True]
    page = export.graph_pages(*export.cap_graph(nodes, edges), "</script><b>").first().page
    assert "</script><b>" not in page and page.count("</script>") == 1
    results = export.result_json(x.entities, x.relationships, x.items, x.mentions, x.statistics())
    result = json.loads(results.first().result_json)
    assert len(result["entities"]) == 4 and len(result["relationships"]) == 2 and len(result["review"]) == 1 and len(result["rejected"]) == 2 and len(result["mentions"]) >= 6 and result["metadata"]["entities"] == 4
    assert set(json.loads(export.exportable(results).first().result_json)) == {"entities", "relationships", "review", "metadata"}
    report = export.report_pages(docs(spark, NOTE, "<b>none</b>"), x.typed, x.entities, x.relationships, x.items, ONTO).orderBy("document_id").collect()
    assert "4 names, 2 links, 1 to review" in report[0].page and report[0].page.count("<mark") >= 6 + 3 and "Ada Byron works for Acme." in report[0].page
    assert "&lt;b&gt;none&lt;/b&gt;" in report[1].page and "0 names" in report[1].page
    capped, inside = export.cap_graph(nodes, edges, 2)
    assert capped.count() == 2 and inside.count() <= 1
    kept = export.marks(x.typed)
    assert kept.where("css_class = 'kept'").count() == 6
    sentence = [r.sentence for r in export.graph_edges(x.entities, x.relationships, x.items).where("not review").orderBy("sentence").collect()]
    assert sentence == ["Acme is headquartered in Rome.", "Ada Byron works for Acme."]


def test_highlight_escapes_and_drops_overlaps(spark):
    span = "array<struct<start:int,end:int,title:string,color:string>>"
    row = spark.createDataFrame([("a <b> c", [(2, 5, 'x"', "red"), (3, 4, "y", "red"), (6, 7, "z", "red")])], f"t string, s {span}")
    out = row.select(export.highlight(F.col("t"), F.col("s")).alias("h")).first().h
    assert out == 'a <mark style="background:red" title="x&quot;">&lt;b&gt;</mark> <mark style="background:red" title="z">c</mark>'


def test_commands_without_a_session(tmp_path, capsys):
    assert cli.run(["init-ontology", str(tmp_path / "o.yaml")]) == 0
    assert cli.run(["validate-ontology", str(tmp_path / "o.yaml")]) == 0
    assert '"legal_pairs"' in capsys.readouterr().out
    assert cli.run(["validate-ontology", "nothing"]) == 1


def test_probe_and_extract_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    (tmp_path / "a.md").write_text("AFRICA is part of ASIA.")
    assert cli.run(["probe", str(tmp_path / "a.md")]) == 0
    assert cli.run(["extract", str(tmp_path / "a.md")]) == 0
    assert "AFRICA" in capsys.readouterr().out
    assert cli.run(["report", str(tmp_path / "a.md"), "--out", str(tmp_path / "pages")]) == 0
    assert "AFRICA" in (tmp_path / "pages" / "a.html").read_text()


def test_long_text_and_repeats(spark):
    long = docs(spark, "word " * 40_000, NOTE, NOTE)
    assert parsing.sentences(long).count() == 7
