"""Text operators on small fixtures: brute force, exact round trips, and the defined results of odd rows."""

from __future__ import annotations

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoweave.llm import leaks, markup, names, quality, sentences, split, tokenize
from ontoweave.llm.markup_pages import PAGES

AT = datetime.datetime(2024, 1, 1)
NO_TOKENIZER = not os.path.exists(tokenize.TOKENIZER_FILE)


# splitting

REQUESTS = "request_id long, text string, section_chars int, overlap_chars int, input_tokens long, max_input_tokens long, received_at timestamp, piece_no string, boundary string"


def requests(spark, rows):
    return spark.createDataFrame([(i, t, c, o, n, m, AT + datetime.timedelta(days=k), "x", "y") for k, (i, t, c, o, n, m) in enumerate(rows)], REQUESTS)


def longest_atom(text):
    return max((m.end() - m.start() for m in split.ATOM.finditer(text)), default=0)


def test_pieces_cover_share_and_fit():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("ab  \n。cdé.") for _ in range(r.randint(1, 70)))
        limit, overlap = r.randint(1, 25), r.randint(0, 30)
        pieces = split.pieces_of(text, limit, overlap)
        shared = split.shared_chars(limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(e - s <= limit for s, e, _, _ in pieces)
        assert all(b[0] + b[2] == a[1] and b[2] == shared for a, b in zip(pieces, pieces[1:]))
        if len(text) > limit:
            assert (longest_atom(text) > limit) == any(p[3] == "forced" for p in pieces)


def test_requests_and_odd_rows(spark):
    rows = [
        (1, "one two three", 5, None, None, None), (2, "abcdefghij", 4, 1, None, None), (3, None, 5, 0, None, None), (4, "", 5, 0, None, None), (5, "short", None, None, None, None),
        (6, "a b c d e f", -1, 0, 10, 5), (7, "old text that is long", 3, 0, None, None), (7, "ok", 30, 0, None, None), (8, "ab", 5, 0, 4, 0), (None, "x y z", 2, 0, None, None), (9, "w " * 40_000, 1000, 50, None, None)]
    pieces = split.split_requests(requests(spark, rows))
    got = {r.request_id: r.boundary for r in split.boundaries(pieces).collect()}
    assert got == {1: "natural", 2: "forced", 6: "natural", 8: "forced", None: "natural", 9: "natural"}
    assert split.split_requests(requests(spark, [])).count() == 0
    assert split.split_requests(requests(spark, [rows[0]] * 3)).count() == split.split_requests(requests(spark, [rows[0]])).count()


# names

PAIRS_ALIKE = [
    ("Ada Byron", "ada byron"), ("Ada Byron", "Byron, Ada"), ("Ada Byron", "A. Byron"), ("Ada Byron", "Ada K. Byron"), ("Ada Byron", "Ada Bryon"), ("Robert Smith", "Bob Smith"), ("Zoë Kurtzman", "Zoe Kurtzmann"),
    ("Fennimore Holdings Ltd", "Fennimore Hldgs"), ("Fennimore Media Group Inc.", "Fennimore (MG) Inc."), ("Fennimore Media Group", "The Fennimore Media Grp"), ("Fennimore University of Technology", "Fennimore Univ. of Tech."), ("Katya Volkova", "Ekaterina Volkova"), ("Fennimore Press and Publishing", "Fennimore P&P"), ("Jo Fennimore", "Jo Fenni-more"), ("Jo Fennimore", "Jo Fenni More"),
]
PAIRS_UNLIKE = [
    ("Ada Byron", "Eva Byron"), ("A. Byron", "Eva Byron"), ("Ada Byron", "Ada Baron Smith"), ("Fennimore Media Group", "Fennimore Biologics"), ("Fennimore", "Fennimore Cloud"), ("Fennimore Server", "Fennimore Studio"),
    ("Ada Byron", "Byron Media Group"), ("Theodore Hall", "Thomas Hall"), ("Anna Hall", "Anthony Hall"), ("Hilda Brook", "Hilda Brooks Ltd"), ("Redwood Hospital", "Redwood House"), ("Fennimore Systems LLC", "Fennimore Systems GmbH"), ("Byron", "Ada Byron"), ("", "Ada Byron"), ("?!", "!?"),
]


@pytest.mark.parametrize(("a", "b"), PAIRS_ALIKE)
def test_alike(a, b):
    assert names.likeness(a, b) >= 0.9


@pytest.mark.parametrize(("a", "b"), PAIRS_UNLIKE)
def test_unlike(a, b):
    assert names.likeness(a, b) < 0.9


def test_bands_meet_the_wanted_recall():
    assert 1 - (1 - names.AT_LIKENESS**names.ROWS) ** names.BANDS >= names.WANTED
    r = random.Random(4)
    met = 0
    for _ in range(300):
        w = "".join(r.choice("abcdefgiklmnoprstuv") for _ in range(9))
        i = r.randrange(9)
        v = w[:i] + r.choice("xyz") + w[i + 1 :]
        met += bool(set(names.band_keys(w)) & set(names.band_keys(v)))
    assert met >= 0.95 * 300


def brute_pairs(spelled, lexicon=None):
    lexicon = lexicon or names.Lexicon()
    return {(a, b) for a in spelled for b in spelled if a < b and names.likeness(a, b, lexicon) >= 0.9}


def table_of(spark, spelled, typed=""):
    return spark.createDataFrame([(x, 1, typed) for x in sorted(set(spelled))], "name string, n long, typed string")


def linked(df, **options):
    return {(x.name_a, x.name_b) for x in names.link_names(df, **options).collect()}


def test_links_equal_all_pairs_on_a_small_table(spark):
    spelled = sorted({n for p in PAIRS_ALIKE + PAIRS_UNLIKE for n in p if n})
    df = names.distinct_names([spark.createDataFrame([(n,) for n in spelled] + [(None,), ("",), ("  ",)] + [(spelled[0],)] * 5, "text string")])
    lexicon = names.learn(df)
    assert linked(df, lexicon=lexicon) == brute_pairs(spelled, lexicon)
    assert names.link_names(df.limit(0)).count() == 0 and names.stars(df.limit(0), names.link_names(df.limit(0))).count() == 0


def crowd():
    r = random.Random(9)
    given = ["John", "Robert", *("".join(r.choice("BDFGKLMNPRSTVZ") + r.choice("aeiou") + r.choice("lmnrst") + r.choice("aeiou") for _ in range(2)).title() for _ in range(40))]
    people = [x for g in given for x in (f"{g} Smith", f"Smith, {g}", f"{g[0]}. Smith")]
    odd = ["Bob Smith", "Smith Bob", "Smith John", "Jhon Smith", "J. Smiht", "William Thomas", "W. Thomas", "Xenia Thomas", "Thomas Jones", "J. Thomas", "Wei Li", "W. Li", "Wei Lu", "Smith Media Group"]
    return sorted({*people, *odd})


def test_frequent_surnames_and_given_names_as_surnames(spark):
    spelled = crowd()
    lexicon = names.Lexicon()
    got = linked(table_of(spark, spelled), lexicon=lexicon)
    assert got == brute_pairs(spelled, lexicon)
    for pair in (("John Smith", "Smith, John"), ("J. Smith", "John Smith"), ("J. Smith", "Smith, John"), ("Bob Smith", "Robert Smith"), ("Robert Smith", "Smith Bob"), ("John Smith", "Smith John"), ("Jhon Smith", "John Smith"), ("J. Smiht", "John Smith"), ("W. Thomas", "William Thomas"), ("W. Li", "Wei Li")):
        assert pair in got, pair
    assert not got & {("J. Thomas", "Thomas Jones"), ("W. Li", "Wei Lu"), ("Wei Li", "Wei Lu"), ("J. Smith", "Robert Smith"), ("John Smith", "Robert Smith")}


def test_split_blocks_keep_every_pair(spark):
    lexicon = names.Lexicon()
    firms = [f"Global {a} {b}" for a in ("Mining", "Media", "Mng", "Steel", "Stl", "Systems") for b in ("Group", "Grp", "Partners", "Trust")]
    spelled = sorted({*crowd(), *firms})
    rows = names.blocks(table_of(spark, spelled), lexicon)
    pairs = lambda most: {(r.name_a, r.name_b) for r in names.candidates(rows, most).collect()}
    whole, split = pairs(10_000), pairs(2)
    assert len(split) < len(whole) / 2
    alike = {p for p in whole if names.likeness(*p, lexicon) >= 0.9}
    assert alike and alike <= split


def test_split_blocks_keep_names_with_several_errors(spark):
    """Pairs that meet in whole blocks and are alike are in the parts too, in whatever way they are alike."""
    lexicon = names.Lexicon()
    people = ["Maximilian Schneider", "Maksimilian Schneider", "Maximilian Schnaidar", "Schnaidar Maxmiliaan", "M. Schneider", "Peter Peters", "Petr Peters", "Peters, Petre", "Margarethe von Schneider", "Magarete Schneider"]
    firms = ["Global Karvanter Belmorid Ltd", "Global Carvanter Pelmorid Ltd", "Global Karvanter Bel Morid", "Global Media Group", "Global (MG)", "Global Mda Grp", "Global Metering Gallery", "Global MG Ltd"]
    long = ["Global Karvanter Belmorid Tassiler Wendover Quistram Orpheline Dunstable Hexamine Jolivette Ltd", "Global Carvanter Pelmorid Dassiler Vendover Kuistram Orfelyne Tunstable Jolivette Xoanon Ltd"]
    rows = names.blocks(table_of(spark, [*people, *firms, *long]), lexicon)
    pairs = lambda most: {(r.name_a, r.name_b) for r in names.candidates(rows, most).collect()}
    whole, split = pairs(10_000), pairs(1)
    alike = {p for p in whole if names.likeness(*p, lexicon) >= 0.9}
    assert {("Maksimilian Schneider", "Maximilian Schneider"), ("Global Carvanter Pelmorid Ltd", "Global Karvanter Belmorid Ltd")} <= alike
    assert alike <= split <= whole and len(split) < len(whole)


def test_links_do_not_hang_on_the_size_of_a_block(spark):
    lexicon = names.Lexicon()
    r = random.Random(11)
    own = ["Meinhart Smith", "Mednuart Smith", "Smith, Meinhartt", "M. Smith", "Max Smith", "Mary Smith"]
    many = {"M" + "".join(r.choice("aeiou") + r.choice("bdfgklmnprstvz") for _ in range(4)) + "t Smith" for _ in range(names.BLOCK_MOST + 20)}
    few = linked(table_of(spark, own), lexicon=lexicon)
    assert few == brute_pairs(own, lexicon) and ("Mednuart Smith", "Meinhart Smith") in few
    assert linked(table_of(spark, [*own, *many]), lexicon=lexicon) == brute_pairs(sorted({*own, *many}), lexicon)
    few = linked(table_of(spark, own), lexicon=lexicon, least=0.5)
    assert few == {p for p in linked(table_of(spark, [*own, *many]), lexicon=lexicon, least=0.5) if set(p) <= set(own)}


def test_names_teach_kinds_and_nicknames(spark):
    cores = ["Brelm", "Tarvok", "Ostin", "Quendal", "Firmok", "Halbert", "Zimmel", "Dorvan"]
    firms = [f"{c} {k} {law}" for c in cores for k in ("Gravures", "Tilings") for law in ("Ltd", "GmbH")]
    people = [f"{g} {s}" for s in ("Orlin", "Hask", "Pelmer", "Vondrak") for g in ("Xanthippe", "Zappy")] + ["Xanthippe Brod", "Odil Brod", "Odil Kell", "Odil Marn"]
    lexicon = names.learn(table_of(spark, firms + people))
    assert {"gravures", "tilings"} <= lexicon.kinds and not {c.lower() for c in cores} & lexicon.kinds
    assert lexicon.nicks["zappy"] == {"xanthippe"} and "odil" not in lexicon.nicks
    assert names.likeness("Xanthippe Neumark", "Zappy Neumark", lexicon) >= 0.9 > names.likeness("Odil Neumark", "Zappy Neumark", lexicon)
    assert names.likeness("Mostyn Gravures", "Mostyn Grvrs", lexicon) >= 0.9
    assert names.likeness("Mostyn Fair", "Mostyn Fayr", lexicon, ("person", "firm")) < 0.9  # what rows are labelled tells kinds apart


def test_learned_nicknames_do_not_hang_on_the_size(spark):
    r = random.Random(10)
    own = ['Xanthippe "Zappy" Orlov', 'Xanthippe "Zappy" Brenn', "Zappy Lund", "Xanthippe Lund", 'Vogel, Katrin "Trini"', 'Vogel, Katrin M. "Trini"', "Trini Lund", "Katrin Lund", 'Lund Odil "Fipsy"', 'Lund Odil "Fipsy" ', "Fipsy Lund"]
    many = [f"{g} {''.join(r.choice('bdfgklmnprstvz') + r.choice('aeiou') for _ in range(4)).title()}" for g in ("Aurel", "Bogdan", "Celine", "Dagmar", "Egon") for _ in range(65)]
    for spelled in (own, own + many):
        got = linked(table_of(spark, spelled))
        assert {("Xanthippe Lund", "Zappy Lund"), ("Katrin Lund", "Trini Lund")} <= got
        assert ("Katrin Lund", "Zappy Lund") not in got
    lexicon = names.Lexicon()
    assert names.quoted_nickname('Lund Odil "Fipsy"', lexicon) is None and names.quoted_nickname('"Bob" Robert Smith', lexicon) == ("bob", "robert")


def test_stars_of_long_chains_end(spark):
    n = 60
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 0.95) for i in range(n)], "name_a string, name_b string, score double")
    spelled = spark.createDataFrame([(f"n{i:03d}", n - i, "") for i in range(n + 1)], "name string, n long, typed string")
    got = names.stars(spelled, links).collect()
    assert len({r.name for r in got}) == len(got) == n + 1


def test_stars_partition_names(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("c", 1), ("d", 1)], "name string, n long")
    links = spark.createDataFrame([("a", "b", 0.95), ("a", "c", 0.95), ("c", "d", 0.91)], "name_a string, name_b string, score double")
    members = names.stars(df, links)
    assert {(r.name, r.centre) for r in members.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert {(r.name_a, r.name_b) for r in names.star_pairs(members).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    none = spark.createDataFrame([], "name_a string, name_b string, score double")
    assert names.stars(df, none).count() == 0


# markup


def test_labelled_pages_are_learnt():
    wrong = [(f, t) for f, t in PAGES if tuple(markup.families_in(t, None)) != tuple(f)]
    assert len(wrong) <= 0.04 * len(PAGES), wrong


HELD_OUT = [
    ("The <b>old</b> mill.", ["html"]), ("Salt &amp; pepper", ["html"]), ("It **is** so.", ["markdown"]), ("Run `make all`.", ["markdown"]), ("See [this](x.md).", ["markdown"]), ("* An item.", ["markdown"]), ("The [[mill]].", ["wiki"]),
    ("== Mills ==", ["wiki"]), ("A '''bold''' one{{cn}}.", ["wiki"]), ("\\section{Mills}", ["latex"]), ("All $k$ of them, \\emph{all}.", ["latex"]), ("It costs $12 to $15.", []), ("If a < b then.", []), ("The Q&A team.", []), ("He wrote [sic].", []),
    ("The min_rows_per_set key.", []), ("Under D:\\x\\y.", []), ("Two * three * four.", []), ("About ~40 of them.", []), ("plain words only", []), ("", []), (None, []),
]


@pytest.mark.parametrize(("text", "families"), HELD_OUT)
def test_held_out_lines(text, families):
    assert markup.families_in(text, None) == families


def test_sum_product_equals_enumeration():
    import itertools
    import math

    text = "A **b [c](d)** {{e}} $5"
    segments = markup.judge(text)
    marks = segments[0]
    edge = markup.model()[2]
    total, on = 0.0, [0.0] * len(marks)
    for root, seg in itertools.product((0, 1), repeat=2):
        for states in itertools.product((0, 1), repeat=len(marks)):
            score = edge[root][seg]
            for m, s in zip(marks, states):
                parent = states[m.parent] if m.parent >= 0 else seg
                score += edge[parent][s] + (markup._own_potential(f"{m.family} {m.sign}", m.flags) if s else 0.0)
            weight = math.exp(score)
            total += weight
            for i, s in enumerate(states):
                on[i] += weight * s
    assert [m.marginal for m in marks] == pytest.approx([x / total for x in on])


def test_clean_keeps_structure():
    cases = {
        "The <b>old</b> &amp; new.": ("The old & new.", "text"), "== Mills ==": ("Mills", "heading"), "* An item.": ("An item.", "list item"), "See [this](x.md) and [[Page|that]].": ("See this and that.", "text"), "\\section{Mills}": ("Mills", "heading"), "<h2>Mills</h2>": ("Mills", "heading"),
    }
    for text, (body, block) in cases.items():
        assert markup.clean(text, markup.judge(text)[0])[:2] == (body, block)
    body, _, codes, formulas = markup.clean("Run `make` for $x_i < 2$.", markup.judge("Run `make` for $x_i < 2$.")[0])
    assert codes == ["make"] and formulas == ["$x_i < 2$"] and "make" in body and "$x_i < 2$" in body


KEPT = [
    ("{{small|Anna}} built it", "Anna built it"), ("Built\\footnote{in old days} well", "Built (in old days) well"), ("[[File:a.png|thumb|A caption]] x", "A caption x"), ("**see [the page](a/b.md)** now", "see the page now"),
    ("| a | **b** |", "a b"), ("Price is $5 and $x^2$ grows.", "Price is $5 and $x^2$ grows."), ("It stands {{cn}} since {{as of|2011}}", "It stands since 2011"), ("A ~~gone **and** lost~~ one", "A gone and lost one"), ("See \\textbf{the [[mill]]} here", "See the mill here"),
]


@pytest.mark.parametrize(("text", "want"), KEPT)
def test_clean_keeps_what_markup_holds(text, want):
    assert markup.clean(text, markup.judge(text)[0])[0] == want


def test_overlapping_pairs_compete():
    marks = markup.judge("Price is $5 and $x^2$ grows.")[0]
    assert [(m.sign, m.marginal > 0.5) for m in marks if m.sign in ("math", "dollar")] == [("dollar", False), ("math", True)]
    assert markup.families_in("A_b_c and __init__", None) == []
    assert markup.families_in("They kept the __gate__ open.", None) == ["markdown"]


def test_signs_of_left_out_pages():
    mean, right = markup.held_out(0.1)
    assert right >= 0.94 and mean > -0.25


def test_sentences_table_and_odd_rows(spark):
    schema = "sentence_id string, text string, heading_path array<string>, parsed_at timestamp, markup string"
    rows = [("a", "plain", ["<b>T</b>"], AT, "q"), ("b", "**x**", None, AT, "q"), ("b", "plain", None, AT + datetime.timedelta(days=1), "q"), ("c", None, [], AT, None), (None, "`c`", [None, ""], None, None), ("d", "<i>" * 3000, [], AT, "q"), ("e", "plain **b", [], AT, "q"), ("e", "plain **b", [], AT, "q")]
    df = spark.createDataFrame(rows, schema)
    assert {(r.sentence_id, r.markup) for r in markup.markup_found(df).collect()} == {("a", "html"), (None, "markdown"), ("d", "html"), ("e", "markdown")}
    assert markup.markup_found(df).count() == 4 and markup.markup_found(df.limit(0)).count() == 0
    assert markup.clean_sentences(df).count() == 6


# sentences

CASES = [
    ("He came. She left.", ["He came.", "She left."]), ("Dr. Ash met Mr. Bo Jr. at No. 5 St. Orlo.", ["Dr. Ash met Mr. Bo Jr. at No. 5 St. Orlo."]), ("It cost 3.5 at 8.30 p.m. It rose.", ["It cost 3.5 at 8.30 p.m.", "It rose."]),
    ("She said, \"It works. Ship it.\" and left.", ["She said, \"It works. Ship it.\" and left."]), ("He called it “odd. Or new.” They laughed.", ["He called it “odd. Or new.”", "They laughed."]), ("Wait... is it so?! Yes.", ["Wait... is it so?!", "Yes."]),
    ("Am 13. März kam er. Der Rest ist in Abb. 4 zu sehen.", ["Am 13. März kam er.", "Der Rest ist in Abb. 4 zu sehen."]), ("„Fertig. Endlich!“, rief Ash.", ["„Fertig. Endlich!“, rief Ash."]), ("« Est-ce prêt ? » demanda M. Bo. Oui !", ["« Est-ce prêt ? » demanda M. Bo.", "Oui !"]),
    ("模型很小。谁来检查？很好！", ["模型很小。", "谁来检查？", "很好！"]), ("「動きますか。はい。」とAshは言った。次だ。", ["「動きますか。はい。」とAshは言った。", "次だ。"]), ("“हाँ। अभी,” Ash ने कहा। बस।", ["“हाँ। अभी,” Ash ने कहा।", "बस।"]), ("هل انتهيت؟ نعم.", ["هل انتهيت؟", "نعم."]),
    ("Τελείωσε; Ναι.", ["Τελείωσε;", "Ναι."]), ("ทุกคนเงียบ ปี 1997 เป็นปีที่ดี ไม่มีใครรู้", ["ทุกคนเงียบ", "ปี 1997 เป็นปีที่ดี", "ไม่มีใครรู้"]), ("ወጣ!Ash መጣ።ሥራው አልቋል?", ["ወጣ!", "Ash መጣ።", "ሥራው አልቋል?"]), ("A title\n\nA line\nbroken here. More.", ["A title", "A line\nbroken here.", "More."]),
    ("It is cheap.See page 4.", ["It is cheap.", "See page 4."]), ("Open gate.Model.py now.", ["Open gate.Model.py now."]), ("(It was cold.) It rained.", ["(It was cold.)", "It rained."]), ("Und u. a. z. B. so.", ["Und u. a. z. B. so."]), ("Tables, etc. Then more.", ["Tables, etc.", "Then more."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentence_cases(text, want):
    assert [text[s:e] for s, e in sentences.sentences_of(text)] == want


def test_sentences_lose_only_white_space():
    r = random.Random(6)
    for _ in range(1500):
        text = "".join(r.choice(['"', "“", "”", "(", ")", ". ", "! ", "a", "B", " ", "\n", "\n\n", "。", "「", "」", "Dr", "3", "…", "'", "»", "«"]) for _ in range(r.randint(1, 40)))
        spans = sentences.sentences_of(text)
        assert all(s < e and text[s:e] == text[s:e].strip() for s, e in spans)
        covered = "".join(text[s:e] for s, e in spans)
        assert "".join(covered.split()) == "".join(text.split())
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_chunks_and_odd_rows(spark):
    rows = [(1, "en", "Ab cd. Ef gh."), (1, "en", "Ab cd. Ef gh."), (2, None, None), (3, "xx", " \n "), (4, "en", ""), (None, "de", "Ja. Nein."), (5, "en", "word " * 30_000)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "chunk_id long, lang string, text string, sentence string")
    got = sorted(((r.chunk_id or 0), r.start_char, r.end_char) for r in sentences.split_texts(df, "chunk_id", "text", "lang").collect())
    assert got == [(0, 0, 3), (0, 4, 9), (1, 0, 6), (1, 7, 13), (5, 0, 149_999)]
    assert sentences.split_texts(df.limit(0), "chunk_id", "text", "lang").count() == 0


# tokens


@pytest.mark.skipif(NO_TOKENIZER, reason="no tokenizer file")
def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenize.TOKENIZER_FILE)
    tok.encode_special_tokens = True
    r = random.Random(8)
    texts = ["", " ", "<|endoftext|>", "a" * 5000, "longlong" * 300, "𝔘 é\u200d\u200b\ufeff", "\t\n \r\n", "don't I'LL"] + ["".join(r.choice("abcdefghij thequring ing-0123é漢字😀\n") for _ in range(r.randint(1, 80))) for _ in range(500)]
    enc = tokenize.encoder()
    assert [enc.encode(t) for t in texts] == [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
    assert all(tok.decode(enc.encode(t), skip_special_tokens=False) == t for t in texts[8:60])


@pytest.mark.skipif(NO_TOKENIZER, reason="no tokenizer file")
def test_ids_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "Hi", None), (3, "Hi", None), (None, "Hi", "k")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0), tuple(r.ids)) for r in tokenize.encode_texts(df, "doc_id", "text").collect())
    assert got == [(0, (17250,)), (1, ()), (2, ()), (3, (17250,)), (3, (17250,))]
    assert tokenize.encode_texts(df.limit(0), "doc_id", "text").count() == 0


LISTS = [
    ("- first item\n- second item\n- third item", ["- first item", "- second item", "- third item"]),
    ("1. First item without stop\n2. Second item", ["1. First item without stop", "2. Second item"]),
    ("Bring these:\n* milk. It is cold.\n    + of a cow\n    + of a goat\n* bread", ["Bring these:", "* milk.", "It is cold.", "+ of a cow", "+ of a goat", "* bread"]),
    ("a) reeds\n   and willows\nb) oaks", ["a) reeds\n   and willows", "b) oaks"]),
    ("1) one\n2) two\n   - left\n   - right\n3) three", ["1) one", "2) two", "- left", "- right", "3) three"]),
    ("It was in May of\n1920. Then it rained.", ["It was in May of\n1920.", "Then it rained."]),
    ("He came at once\n- so they say - and left.", ["He came at once\n- so they say - and left."]),
    ("Wir sahen\nu. a. einen Fluss. Es regnete.", ["Wir sahen\nu. a. einen Fluss.", "Es regnete."]),
]


@pytest.mark.parametrize(("text", "want"), LISTS)
def test_items_of_lists_are_units(text, want):
    assert [text[s:e] for s, e in sentences.sentences_of(text)] == want


@pytest.mark.parametrize("n", [1, 3, 30, 300])
def test_a_verb_of_saying_counts_however_far_it_stands(n):
    text = '"قف!" ' + "ثم بعد ذلك " * n + "قال الرجل."
    assert len(sentences.sentences_of(text)) == 1


# leaks

ITEM = "Explain why the frozen ledger should reload before the corpus and name one exporter that breaks this order"


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        words = leaks.plain_words(t)
        for i, x in items:
            item = leaks.plain_words(x)
            n = min(leaks.RUN, len(item))
            if n and any(item[a : a + n] == words[b : b + n] for a in range(len(item) - n + 1) for b in range(len(words) - n + 1)):
                out.add((d, i))
    return out


def test_runs_begin_and_end_with_words():
    assert leaks.Stream(["the", "panda", "cat", "sat"]).holds("catsat")
    assert not leaks.Stream(["the", "panda", "cat", "sat"]).holds("acatsat")
    assert leaks.Stream(["a", "data", "base"]).holds("database") and not leaks.Stream(["cat", "sats"]).holds("catsat")


def test_longest_common_equals_the_table():
    r = random.Random(3)
    for _ in range(300):
        a, b = [[r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert leaks.longest_common(a, b) == best[-1][-1]


@pytest.mark.parametrize("near", [0.95, 0.7, 0.2])
def test_block_search_misses_nothing(near):
    rng = np.random.default_rng(5)
    blocks = rng.standard_normal((700, 12)).astype(np.float32)
    found = np.vstack([blocks[:200] + 0.2 * rng.standard_normal((200, 12)), rng.standard_normal((900, 12))]).astype(np.float32)
    blocks, found = leaks._unit(blocks), leaks._unit(found)
    got = {(r, q) for rows, queries, _ in leaks.Blocks(blocks, near).hits(found) for r, q in zip(rows, queries)}
    assert got == set(zip(*np.nonzero(found @ blocks.T >= near)))


def test_paraphrases_need_the_order_and_the_answer(spark):
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("mo", "ri", "ta", "ke", "su", "lo") for b in ("den", "fal", "gor", "hin", "jat", "kel", "lum", "nip")]
    filler = [" ".join(r.choice(words) for _ in range(90)) for _ in range(40)]
    item = [r.choice(words) for _ in range(40)]
    item[10], item[30] = "1871", "quatern"
    changed = [f"other{k}" if k % 8 == 3 else x for k, x in enumerate(item)]
    wrong = ["1999" if x == "1871" else x for x in changed]
    docs = [*enumerate(filler), (100, f"{filler[0]} {' '.join(changed)} {filler[1]}"), (101, f"{filler[2]} {' '.join(wrong)} {filler[3]}"), (102, " ".join(r.sample(changed, len(changed)))), (103, " ".join(changed))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(x.doc_id, x.kind) for x in leaks.leaks(d, i).collect()}
    assert got == {(100, "paraphrase"), (103, "paraphrase")}  # neither another number nor another order


def test_long_texts_are_searched_in_segments(spark):
    long = " ".join(f"w{k}" for k in range(3 * leaks.SEGMENT))
    at = 2 * leaks.SEGMENT - 5
    item = " ".join(f"w{k}" for k in range(at, at + 14))
    d = spark.createDataFrame([(1, long), (2, "w1 w2")], "doc_id long, text string")
    i = spark.createDataFrame([(7, item), (8, "w1 w2")], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in leaks.leaks(d, i).where("kind = 'exact'").collect()} == {(1, 7), (1, 8), (2, 8)}


def test_leaks_equal_brute_force(spark):
    w = ITEM.split()
    docs = [
        (1, "Note. " + ITEM + " End."), (2, "> " + " \n> ".join(w)), (3, ITEM.upper()), (4, "x " + " ".join(w[3:15]) + " y"), (5, "x " + " ".join(w[3:14]) + " y"), (6, " ".join(f"**{x}**" for x in w)), (7, " ".join("quite" if k % 5 == 4 else x for k, x in enumerate(w))),
        (8, None), (9, ""), (10, "What makes it so?"), (11, "the led\u00adger <b>Explain</b>&nbsp;" + "&nbsp;".join(w[1:])), (12, "ok " * 5000), (None, ITEM)]
    items = [(1, ITEM), (2, ITEM.lower()), (3, None), (4, ""), (5, "?!"), (6, "What makes it so?"), (7, "Two words")]
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, i).where("kind = 'exact'").collect()}
    assert got == brute_leaks(docs, items)
    assert {x for x, _ in got} == {None, 1, 2, 3, 4, 6, 10, 11}
    assert leaks.leaks(d, i.limit(0)).count() == 0
    assert leaks.leaks(d.limit(0), i).count() == 0


# quality

KINDS = [
    ("The frozen ledger was moved in October. She said that it was not so, and that the others had to wait for it.", "prose"), ("| a | b |\n| --- | --- |\n| one | 2 |\n| two | 3.5 |\n| six | n/a |", "table"), ("name,n,day\nash,3,2023-01-02\nbo,4,2023-02-03\ncy,5,\ndi,,2023-01-01", "table"),
    ("one\ttwo\nash\t3\nbo\t4\ncy\t5", "table"), ("* milk\n* bread\n* old cheese\n* eggs", "list"), ("1. milk\n2) bread\n3. eggs\n4. tea", "list"), ("milk: two\nbread: one\neggs: six\ntea: none", "list"), ("<ul>\n<li>milk</li>\n<li>bread</li>\n</ul>", "list"),
    ("ok " * 60, "junk"), ("4f 9b 42 47 83 b5 38 59\n3b 13 51 2e 29 82 18 e3\naa bb cc dd ee ff 00 11", "junk"), ("\ufffd\u25a1\u25a0?" * 60, "junk"), ("QUJD" * 50 + "x+/9Zk", "junk"), ("longlong" * 30, "junk"), ("每晚，他检查了记录。记录包含27行旧的标题。它很小，但是很快。", "prose"),
    ("Der alte Bericht liegt seit Montag bei den anderen. Niemand kannte ihn, bis er am Abend gezeigt wurde.", "prose"), ("<p>It was <b>late</b> when they came to the mill, and nobody had seen them on the road.</p>", "prose"), (None, None), ("", None), (" \n\t", None),
]


@pytest.mark.parametrize(("text", "kind"), KINDS)
def test_kinds(text, kind):
    assert quality.describe(text)["text_kind"] == kind


PROSE = "The frozen ledger was moved in October, and she said that the others had to wait for it."
ROWS = "\n".join(f"| {a} | {i} | {i * 7} |" for i, a in enumerate(("one", "two", "six", "ten", "four")))
ENTRIES = "* milk\n* old bread\n* eggs"
MIXED = [
    (f"{PROSE}\n{ROWS}\n{ENTRIES}", "table"), (f"{PROSE}\n{ENTRIES}\n* tea from the hills\n* a small wheel of cheese\n* salted butter\n* honey\n| a | 2 |", "list"), ("* milk\n* old bread", "list"), (f"{PROSE} {PROSE}\n{ROWS}", "prose"),
    ("文書には26行の小さな記録がある{{citation needed|date=May}}。春に、判定を作り直した。", "prose"), ("Ashは古い索引を使いました [http://plan.example plan page]。毎晩候補を確認する。", "prose"),
]


@pytest.mark.parametrize(("text", "kind"), MIXED)
def test_kinds_of_mixed_and_short_texts(text, kind):
    assert quality.describe(text)["text_kind"] == kind


def test_divergence():
    assert quality.jensen_shannon((0.5, 0.5), (0.5, 0.5)) == 0
    assert quality.jensen_shannon((1, 0), (0, 1)) == pytest.approx(1)
    known, kinds = quality.profiles()
    assert np.allclose(known.sum(axis=1), 1) and set(kinds) == {0, 1, 2, 3}
    assert quality.divergences(known, known).diagonal() == pytest.approx(0, abs=1e-9)


FOREIGN = [
    "यह पुस्तक बहुत अच्छी है। मैंने कल इसे पढ़ा और आज फिर से पढ़ूँगा।", "இது ஒரு நல்ல புத்தகம். நான் அதை நேற்று படித்தேன். மழை பெய்தது.", "এটি একটি ভালো বই। আমি গতকাল এটি পড়েছি।", "เมื่อวานฝนตก เราอยู่บ้านทั้งวัน",
    "Χθες έβρεχε όλη μέρα. Είναι έτοιμο το φαγητό;", "اليوم وصل التقرير إلى المدينة. لم يقرأه أحد بعد.", "ትናንት ዝናብ ነበር። እኛ ቤት ቆየን።", "어제 비가 왔다. 우리는 집에 있었다.", "Вчера шёл дождь. Мы весь день были дома.",
]


@pytest.mark.parametrize("text", FOREIGN)
def test_prose_of_any_language_is_prose(text):
    assert quality.describe(text)["text_kind"] == "prose"


def test_wrapped_prose_is_one_sentence_however_many_lines_it_has():
    line = "and then the boats came down the river with the wood"
    assert quality.pieces_of("\n".join([line] * 30 + ["to the mill."]))[0] == [" ".join([line] * 30 + ["to the mill."])]


def test_languages_are_fitted_from_a_bounded_sample(spark):
    rows = [("xx", f"zib zab {w} zob.") for w in ("mil", "nol", "pel", "ral", "sol", "tul")] * 5 + [(None, "a"), ("", "b"), ("xx", ""), ("xx", "z" * 6000)]
    sample = quality.language_sample(spark.createDataFrame(rows, "lang string, text string"))
    assert len(sample) == 6  # copies count once, long and blank texts not at all
    fitted = quality.fit_languages(sample * 5)
    assert quality.nearest_language("zib zab mil zob.", fitted)[0] == "xx" and "de" in fitted


def test_stats_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b. c", "q"), (2, None, None), (None, "", "q"), (3, "word " * 50_000, "q"), (1, "a b. c", "q")], "doc_id long, text string, text_kind string")
    got = {r.doc_id: r for r in quality.text_stats(df).collect()}
    assert got[1].n_words == 3 and got[2].n_words == 0 and got[None].text_kind is None and got[3].text_kind == "junk" and got[3].n_words == 50_000
    assert quality.text_stats(df.limit(0)).count() == 0


def test_queries_have_the_given_columns(spark, smoke_dir):
    from ontoweave.llm import queries

    want = {"p1_found": ["request_id", "boundary"], "p4_found": ["sentence_id", "markup"], "p6_found": ["chunk_id", "start_char", "end_char"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "text_kind"]}
    for name, columns in want.items():
        df = queries.queries()[name](spark, smoke_dir)
        assert df.columns == columns
        plain = df.select(*[F.col(c).cast("string") for c in columns])
        assert plain.count() == plain.distinct().count()
