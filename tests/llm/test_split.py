import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.split import cut, split_oversized

TEXT = st.text(st.sampled_from("ab .\n\r#-\té"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(3, 12), st.integers(5, 60), st.integers(0, 2))
def test_pieces_cover_and_fit(text, words, chars, overlap):
    pieces = cut(text, words, chars, overlap)
    at = 0
    for i, (a, b) in enumerate(pieces):
        assert b - a <= chars and len(re.findall(r"[^ \t\r\n]+", text[a:b])) <= words
        assert a <= at or not text[at:a].strip(" \t\r\n")
        if i:
            assert pieces[i - 1][0] < a and pieces[i - 1][1] < b
            assert len(re.findall(r"[^ \t\r\n]+", text[a : pieces[i - 1][1]])) <= overlap
        at = b
    assert not text[at:].strip(" \t\r\n")


def test_natural_boundaries():
    text = "one two three four.\n\nfive six seven. eight nine ten eleven"
    assert [text[a:b] for a, b in cut(text, 6, 1000, 0)] == ["one two three four.", "five six seven.", "eight nine ten eleven"]


def test_rows(spark):
    long = "\r\n".join(f"w{i} x." for i in range(400))
    rows = [(1, long, 10, "z", 0), (1, long, 10, "z", 0), (2, None, 1, "z", 0), (3, "", 1, "z", 0), (4, "short", 1, "z", 0), (5, "y" * 9001, None, "z", 0), (6, " " * 5000, 3, "z", 0), (7, " ".join(["a"] * 300), 1, "z", 0), (8, " ".join(["a"] * 301), 1, "z", 0)]
    df = spark.createDataFrame(rows, "id int, text string, line int, piece string, n_pieces int")
    out = split_oversized(df, "id", "text", "line").distinct().collect()
    by = {k: sorted((r for r in out if r.id == k), key=lambda r: r.piece) for k in {r.id for r in out}}
    assert set(by) == {1, 5, 6, 8}
    assert [len(r.text) for r in by[5]] == [4000, 4000, 1001] and by[5][0].line_start is None
    assert [r.text for r in by[6]] == [""]
    lines = long.split("\r\n")
    for r in by[1]:
        assert lines[r.line_start - 10].startswith(r.text.split(" ")[0])
    assert split_oversized(df.limit(0), "id", "text", "line").count() == 0
