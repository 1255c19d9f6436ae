"""Proposers and their merge, against loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ontoweave.operators import mentions

SENT = "document_id string, sentence_id string, text string, start_char int, heading_path array<string>"


def sents(spark, *texts):
    return spark.createDataFrame([("d", f"s{i}", t, 100 * i, []) for i, t in enumerate(texts)], SENT)


def names(spark, *listed):
    return spark.createDataFrame([(n, "T", i) for i, n in enumerate(listed)], "name string, type string, ord int")


def spans(rows):
    return sorted((r.sentence_id, r.start_char, r.end_char, r.text) for r in rows.collect())


def find_listed(text: str, listed: list[str]) -> list[tuple[int, int]]:
    taken: list[tuple[int, int]] = []
    for name in sorted(listed, key=len, reverse=True):
        at = 0
        while (i := text.lower().find(name.lower(), at)) >= 0:
            j = i + len(name)
            free = not any(i < b and a < j for a, b in taken)
            bounded = (i == 0 or not text[i - 1].isalnum()) and (j == len(text) or not text[j].isalnum())
            if free and bounded:
                taken.append((i, j))
                at = j
            else:
                at = i + 1
    return sorted(taken)


def test_listed_names_equal_the_loop_both_ways(spark):
    r = random.Random(2)
    listed = ["ab", "ab cd", "cd ab", "a", "b-a", "cd", "ab cd ab", "x.", "(cd", "--"]
    texts = [" ".join(r.choice(["ab", "cd", "a", "AB", "b-a", "abc", "x.", "(cd", "--"]) for _ in range(r.randint(1, 9))) for _ in range(150)]
    want = sorted((f"s{i}", 100 * i + a, 100 * i + b, t[a:b]) for i, t in enumerate(texts) for a, b in find_listed(t, listed))
    assert spans(mentions.listed_names(sents(spark, *texts), names(spark, *listed))) == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert spans(mentions.listed_names(sents(spark, *texts), names(spark, *listed))) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_listed_names_edges(spark):
    assert spans(mentions.listed_names(sents(spark, None, "", "x"), names(spark, "y", ""))) == []
    assert spans(mentions.listed_names(sents(spark, "é Zoë é"), names(spark, "zoë"))) == [("s0", 2, 5, "Zoë")]


def test_cues(spark):
    found = spans(mentions.markdown_cues(sents(spark, "The **Big One** and [a link](u) and `code`, __Two__.")))
    assert [(a, t) for _, a, _, t in found] == [(6, "Big One"), (21, "a link"), (37, "code"), (46, "Two")]


def test_pronouns_are_whole_words(spark):
    found = mentions.pronouns(sents(spark, "It sat; sit, THEIR élit it_"))
    assert [r.text for r in found.orderBy("start_char").collect()] == ["It", "THEIR"]
    assert {r.skipped_reason for r in found.collect()} == {"pronoun"}


def test_capital_runs(spark):
    found = [r.text for r in mentions.capital_runs(sents(spark, "The Bank of England met Jane Doe's team in Port Imre on Monday.")).orderBy("start_char").collect()]
    assert found == ["Bank of England", "Jane Doe", "Port Imre"]


def plain_merge(items):
    kept = []
    for a, b, src in sorted(items, key=lambda s: (s[0], s[0] - s[1], s[2])):
        if any(a < y and x < b and y - x >= b - a for x, y, _ in kept):
            continue
        kept = [(x, y, s) for x, y, s in kept if not (a < y and x < b) or y - x > b - a] + [(a, b, src)]
    return sorted(kept)


def test_merge_equals_the_loop(spark):
    r = random.Random(9)
    groups = {f"s{g}": [(a := r.randint(0, 20), a + r.randint(1, 8), r.choice(["encoder", "gazetteer", "markdown"])) for _ in range(r.randint(1, 8))] for g in range(200)}
    rows = [("d", s, "x" * (b - a), a, b, src, None, []) for s, items in groups.items() for a, b, src in items]
    schema = "document_id string, sentence_id string, text string, start_char int, end_char int, source string, skipped_reason string, heading_path array<string>"
    out = {}
    for x in mentions.merge(spark.createDataFrame(rows, schema)).collect():
        out.setdefault(x.sentence_id, []).append((x.start_char, x.end_char, x.source))
    assert {s: sorted(v) for s, v in out.items()} == {s: plain_merge(v) for s, v in groups.items()}


def test_merge_keeps_skipped(spark):
    schema = "document_id string, sentence_id string, text string, start_char int, end_char int, source string, skipped_reason string, heading_path array<string>"
    rows = [("d", "s", "it", 0, 2, "shape", "pronoun", []), ("d", "s", "it", 0, 2, "shape", "pronoun", []), ("d", "s", "it is", 0, 5, "encoder", None, [])]
    assert mentions.merge(spark.createDataFrame(rows, schema)).count() == 3


def test_occurrences_and_attach(spark):
    docs = spark.createDataFrame([("d", "Anne met Ann in Berlin, ann.")], "doc_id string, text string")
    assert docs.select(mentions.occurrences(F.col("text"), F.lit("Ann")).alias("o")).first().o == [9, 24]
    named = spark.createDataFrame([("d", 0, "Ann"), ("d", 1, "Ann"), ("d", 2, "Ann"), ("d", 3, "Berlin"), ("d", 4, "Ziggy")], "doc_id string, ord int, name string")
    got = {r.ord: (r.start_char, r.end_char) for r in mentions.attach_spans(docs, named).collect()}
    assert got == {0: (9, 12), 1: (24, 27), 2: (-3, -3), 3: (16, 22), 4: (-5, -5)}


def test_runs_over_listed_names_are_none(spark):
    texts = sents(spark, "The Acme Bank met Jo Vane. Acme left.")
    listed = mentions.listed_names(texts, names(spark, "acme"))
    assert [t for *_, t in spans(mentions.capital_runs(texts, listed))] == ["Jo Vane"]
    assert sorted(t for *_, t in spans(mentions.propose(texts, names(spark, "acme"), capitals=True))) == ["Acme", "Acme", "Jo Vane"]


def test_encoder_and_suggestions(spark):
    def encode(batches):
        for texts in batches:
            yield [[(0, 3, 0.9), (0, 2, 0.1), (2, 99, 0.9)] for _ in texts]

    assert spans(mentions.encoder_spans(sents(spark, "Ann sat"), encode, 0.5)) == [("s0", 0, 3, "Ann")]
    texts = sents(spark, "Odd start here.", "We saw Big Ben.", "Then Big Ben and Rome.", "Names of Acme.", "Jo Vane of Acme came.")
    found = {(r.name, r.n, r.rank) for r in mentions.suggest_names(texts, names(spark, "acme")).collect()}
    assert ("Big Ben", 2, 1) in found and ("Rome", 1, 3) in found and ("Jo Vane", 1, 2) in found and not any(n in ("Odd", "Acme", "Names") for n, _, _ in found)


def test_names_with_signs_around_them(spark):
    texts = ("a .NET app, C++ and c# or -> and ** here", "x->y --> z ***", "No.NET .net")
    listed = (".NET", "C++", "->", "**", "C#")
    want = set()
    for i, text in enumerate(texts):
        low, taken = text.lower(), []
        for name in sorted(listed, key=lambda n: (-len(n), listed.index(n))):
            at = low.find(name.lower())
            while at >= 0:
                end = at + len(name)
                if not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()) and not any(at < b and a < end for a, b in taken):
                    taken.append((at, end))
                at = low.find(name.lower(), at + 1)
        want |= {(f"s{i}", text[a:b], a, b) for a, b in taken}
    rows = spark.createDataFrame([("d", f"s{i}", t, 0, []) for i, t in enumerate(texts)], "document_id string, sentence_id string, text string, start_char int, heading_path array<string>")
    table = spark.createDataFrame([(n, "T", i) for i, n in enumerate(listed)], "name string, type string, ord long")
    assert {(r.sentence_id, r.text, r.start_char, r.end_char) for r in mentions.listed_names(rows, table).collect()} == want
