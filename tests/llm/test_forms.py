import pytest

from docloom.llm.forms import alike_pairs, one_form, plain, rewritings

SAME = [
    ("a b", "a b"), ("a b", "a  b"), ("ab", "a​b"), ("ab", "a­b"), ("Café", "Café"), ("file", "ﬁle"), ("A1!", "Ａ１！"), ("a-b", "a‑b"), ("a\nb", "a \r\nb"), ("K", "K"), (" ab ", "ab"), ("‏ab", "ab"),
]
OTHER = [("a", "A"), ("e", "é"), ("m2", "m²"), ("...", "…"), ("1", "①"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("ab", "a b"), ("a\nb", "a b"), ("oe", "œ")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert plain(a) == plain(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert plain(a) != plain(b)


def test_scripts():
    assert rewritings("pаcket", "LATIN") == ["packet"]
    assert rewritings("Тһе", "LATIN") == ["The"] and rewritings("сор", "CYRILLIC") == []
    assert rewritings("вoда", "CYRILLIC")[0] == "вода"
    assert rewritings("наst", "CYRILLIC") == ["наѕт"][:0] or "наst" not in rewritings("наst", "CYRILLIC")


def test_accents_over_lookalikes():
    assert rewritings("résumе́", "LATIN") == ["résumé"] and rewritings("е́té", "LATIN") == ["été"]
    assert rewritings("ё" + "лка", "CYRILLIC") == []


def test_accent_pairs(spark):
    rows = [(1, "une cl\u00e9 rouge"), (2, "une cl\u0435\u0301 rouge"), (3, "une cle\u0301 rouge"), (4, "une cle rouge"), (5, "sesi\u00f3n"), (6, "sesi\u03ccn"), (7, "\u04d3ltere Version"), (8, "\u00e4ltere Version")]
    pairs = {tuple(r) for r in alike_pairs(one_form(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (5, 6), (7, 8)}


def test_rows(spark):
    rows = [(1, "the packet waits", 0), (2, "the pаcket waits", 0), (3, "the packet waits", 0), (4, "the packet waits.", 0), (5, None, 0), (6, "", 0), (7, "​", 0), (8, "lonely раrsеr", 0), (9, "​ ", 0),
            (10, "Тһе packet waits", 0), (11, "The packet waits", 0), (12, "вода и сор", 0), (13, "zeаlot", 0), (14, "zealоt", 0), (15, "y " * 60_000 + "а", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form int")
    pairs = {tuple(r) for r in alike_pairs(one_form(df, "doc_id", "text")).collect()}
    assert pairs == {(1, 2), (2, 3), (10, 11), (13, 14)}
    texts = {r.key: r.text for r in one_form(df, "doc_id", "text", with_text=True).collect()}
    assert texts[2] == "the packet waits" and texts[12] == "вода и сор" and texts[13] == "zealot" and texts[8] == "lonely раrsеr"
    assert alike_pairs(one_form(df.limit(0), "doc_id", "text")).count() == 0
