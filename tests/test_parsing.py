"""The parser against hand-written scans and named scenarios."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ontoweave.functions.text import ABBREVIATIONS
from ontoweave.operators import parsing
from ontoweave.plans import notes

DOCS = "document_id string, text string"


def frame(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], DOCS)


def texts_of(rows):
    return [r.text for r in sorted(rows.collect(), key=lambda r: (r.document_id, r.idx))]


def scan_sentences(chunk: str) -> list[str]:
    """A plain scan for sentence ends: the brute force."""
    out, start, i = [], 0, 0
    while i < len(chunk):
        if chunk[i] in ".!?":
            k = i
            while k > 0 and chunk[k - 1].isalpha():
                k -= 1
            j = i + 1
            while j < len(chunk) and chunk[j] in ".!?\"')":
                j += 1
            if chunk[k:i].lower() not in ABBREVIATIONS and (j == len(chunk) or chunk[j].isspace()):
                out.append(chunk[start:j])
                start = i = j
                continue
        i += 1
    return [s.strip() for s in [*out, chunk[start:]] if s.strip()]


def test_sentences_equal_the_scan(spark):
    r = random.Random(5)
    words = ["Mr", "Inc", "go", "Ah", "é", "no", "x1", "end", '"', "(", "e.g", "3.5"]
    texts = ["".join(r.choice(words) + r.choice([" ", ". ", "! ", "?) ", '." ', ".", "... ", " "]) for _ in range(r.randint(1, 12))) for _ in range(400)]
    docs = frame(spark, *texts)
    found = {}
    for row in sorted(parsing.sentences(docs).collect(), key=lambda x: x.idx):
        found.setdefault(row.document_id, []).append(row.text)
    for i, t in enumerate(texts):
        assert found.get(f"d{i}", []) == scan_sentences(t), t


def test_offsets_slice_the_text(spark):
    text = "---\nid: 1\n---\n# Títle\n\n  One é. Two 𝔘!\r\nstill two\n\n```\ncode. here.\n```\n## Sub\nThree.\n"
    rows = parsing.sentences(frame(spark, text)).collect()
    assert [text[r.start_char : r.end_char] for r in rows] == [r.text for r in rows]
    assert [r.text for r in sorted(rows, key=lambda r: r.idx)] == ["One é.", "Two 𝔘!", "still two", "Three."]
    assert {r.text: list(r.heading_path) for r in rows}["Three."] == ["Títle", "Sub"]


def test_heading_stack(spark):
    text = "# A\n### C\nx.\n## B\ny.\n# D\nz.\n#no\n"
    rows = {r.text: list(r.heading_path) for r in parsing.sentences(frame(spark, text)).collect()}
    assert rows["x."] == ["A", "C"] and rows["y."] == ["A", "B"] and rows["z."] == ["D"]


def test_fences(spark):
    rows = parsing.fence_regions(frame(spark, "a\n```\nb\n```\nc\n```py\nd")).collect()
    assert sorted((r.start_char, r.end_char) for r in rows) == [(2, 11), (14, 21)]


def test_blocks_and_bounds(spark):
    text = "- one\n- two\n| a | b |\n> q\n1. x\nplain\n"
    assert len(texts_of(parsing.sentences(frame(spark, text), blocks=True))) >= 5
    long = frame(spark, "alpha " * 900, "x" * 2000)
    pieces = parsing.sentences(long, max_chars=500).collect()
    assert max(len(p.text) for p in pieces) <= 500
    assert sum(len(p.text.replace(" ", "")) for p in pieces) == 900 * 5 + 2000


@pytest.mark.parametrize("most", [7, 50])
def test_cut_ranges_lose_nothing(most):
    r = random.Random(most)
    for _ in range(300):
        t = "".join(r.choice("ab ,;\n|:") for _ in range(r.randint(0, 120)))
        cuts = parsing.cut_ranges(t, most)
        assert "".join(t[a:b] for a, b in cuts) == t and all(0 < b - a <= most for a, b in cuts)


def test_null_empty_blank(spark):
    assert parsing.sentences(frame(spark, None, "", " \n\n ", "# only", "```\nx")).collect() == []
    assert parsing.lines(spark.createDataFrame([], DOCS)).collect() == []


def test_token_spans_both_ways(spark):
    df = spark.createDataFrame([("a", ["New", "York", "é"]), ("b", [])], "id string, t array<string>")
    folded = df.where(F.size("t") > 0).select(parsing.token_spans(F.col("t")).alias("s")).first().s
    assert [(x.token, x.start, x.end) for x in folded] == [("New", 0, 3), ("York", 4, 8), ("é", 9, 10)]
    assert sorted((r.start_char, r.end_char) for r in parsing.token_rows(df, "id", "t").collect()) == [(0, 3), (4, 8), (9, 10)]


def test_convert_spans_raises_on_a_bad_end(spark):
    schema = "doc_id string, tokens array<string>, entities array<struct<type:string,start:int,end:int>>, relations array<struct<type:string,head:int,tail:int>>"
    good = spark.createDataFrame([("d", ["Jo", "of", "Rome"], [("Peop", 0, 1), ("Loc", 2, 3)], [("Live_In", 0, 1)])], schema)
    ents, rels = parsing.convert_spans(good, {"Peop": "PERSON"}, {})
    assert {(r.name, r.type, r.start_char) for r in ents.collect()} == {("Jo", "PERSON", 0), ("Rome", "Loc", 6)}
    assert [(r.source, r.target, r.type) for r in rels.collect()] == [("Jo", "Rome", "Live_In")]
    bad = spark.createDataFrame([("d", ["Jo"], [("Peop", 0, 1)], [("Live_In", 0, 7)])], schema)
    with pytest.raises(Exception, match="no entity"):
        parsing.convert_spans(bad, {}, {})[1].collect()


def scan_lines(text: str) -> tuple[int, int, int] | None:
    """(n_lines, last_start, n_chars) of the lines that are not empty, after front matter: the brute force."""
    head = re.match(parsing.FRONT_MATTER.replace(r"(?s)\A", "(?s)"), text)
    at, found = head.end() if head else 0, []
    for line in text[at:].split("\n"):
        bare = line.removesuffix("\r")
        found += [(at, len(bare))] if bare else []
        at += len(line) + 1
    return (len(found), found[-1][0], sum(n for _, n in found)) if found else None


def test_document_lines_read_every_document(spark, tmp_path):
    r = random.Random(11)
    texts = ["---\nid: 1\n---\nOne.\n\nTwo.\n", "---\r\nid: 2\r\n---\r\nÉ 𝔘.\r\nx", "---\nnever closed\n\nx", "--- a dash first", "---", "---\nid: 3\n---\n", "a\n---\nb\n---\nc", "\n---\nx\n---\ny", "", None]
    texts += ["".join(r.choice(["---\n", "\n", "\r\n", "a: b\n", "é", " "]) for _ in range(r.randint(1, 12))) for _ in range(300)]
    frame(spark, *texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.document_id: (x.n_lines, x.last_start, x.n_chars) for x in notes.document_lines(spark, str(tmp_path)).collect()}
    assert got == {f"d{i}": want for i, t in enumerate(texts) if t and (want := scan_lines(t))}
