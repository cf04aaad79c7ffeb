from hypothesis import given, settings
from hypothesis import strategies as st

from vectrail.llm import splitting as S


@given(st.text(alphabet=st.sampled_from("ab. !?\n\t\r#́é\f"), max_size=400), st.integers(5, 60), st.data())
@settings(max_examples=200, deadline=None)
def test_round_trip_and_limit(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    out = S.pieces(text, limit, overlap)
    assert all(b - a <= limit for a, b, _ in out)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for (_, b, _), (c, e, _) in zip(out, out[1:], strict=False):
        assert c == max(0, b - overlap) and e > b
    assert text[out[0][0] : out[0][1]] + "".join(text[b:e] for (_, b, _), (_, e, _) in zip(out, out[1:], strict=False)) == text


def test_boundaries():
    p = "x" * 40
    assert S.sufficient_boundary(f"{p}\n \t\n{p}", 50) == "paragraph"
    assert S.sufficient_boundary(f"{p}\n{p}", 50) == "line"
    assert S.sufficient_boundary(f"{p}. {p}", 50) == "sentence"
    assert S.sufficient_boundary(f"{p} {p}", 50) == "none"
    assert S.sufficient_boundary(f"  \t{'x' * 50}\r\n\n   {p}", 50) == "paragraph"
    assert S.sufficient_boundary(f"{p}.{p}", 50) == "none"


def test_cuts_prefer_natural_boundaries():
    text = "A first one. A second one.\n\nA new paragraph here."
    assert [text[a:b] for a, b, _ in S.pieces(text, 30, 0)] == ["A first one. A second one.\n\n", "A new paragraph here."]


def test_table(spark):
    rows = [(1, "word " * 100, 9), (2, "short", 9), (3, None, 9), (4, "", 9), (None, "y" * 300, 9), (1, "word " * 100, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece_no int")
    got = S.split_oversized(df, 100, 10)
    assert {r.doc_id for r in got.collect()} == {1, None}
    assert all(len(r.piece) == r.length <= 100 for r in got.collect())
    assert S.split_oversized(df.limit(0), 100, 10).count() == 0
