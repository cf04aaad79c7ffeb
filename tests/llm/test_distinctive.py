import math
from collections import Counter

import pytest

from vectrail.llm import distinctive as D
from vectrail.llm.records import current_postings, tokens

TEXTS = {1: "alpha alpha beta the the", 2: "beta gamma the", 3: "alpha the the delta", 4: "the"}


def brute(prior=500.0):
    counts = {i: Counter(tokens(t)) for i, t in TEXTS.items()}
    all_ = sum(counts.values(), Counter())
    total = sum(all_.values())
    out = {}
    for i, c in counts.items():
        n = sum(c.values())
        for w, y in c.items():
            a, o = prior * all_[w] / total, all_[w] - y
            lo = math.log((y + a) / (n + prior - y - a)) - math.log((o + a) / (total - n + prior - o - a))
            out[i, w] = (y, sum(w in d for d in counts.values()), lo / math.sqrt(1 / (y + a) + 1 / (o + a)))
    return out


@pytest.mark.parametrize("by", ["texts", "counts"])
def test_scores(spark, by):
    if by == "texts":
        rows = [(i, t, "clash") for i, t in TEXTS.items()] + [(8, None, ""), (9, "", ""), (None, None, "")]
        got = D.distinctive_in_texts(spark.createDataFrame(rows, "doc_id bigint, text string, term string"))
    else:
        rows = [(i, w, n) for i, t in TEXTS.items() for w, n in Counter(tokens(t)).items()]
        got = D.distinctive_in_counts(spark.createDataFrame(rows, "rec_id bigint, term string, tf int"))
    want = brute()
    found = {(r.rec_id, r.term): (r.tf, r.df, r.z) for r in got.collect()}
    assert found.keys() == want.keys()
    for k, (y, df, z) in want.items():
        assert found[k][:2] == (y, df) and found[k][2] == pytest.approx(z)


def test_ranges_restrict_rows_not_counts(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    got = {(r.rec_id, r.term): r.z for r in D.distinctive_in_texts(df, min_tf=2, pattern="[a-z]{4,}", min_df=2, max_df=3).collect()}
    assert got == {(1, "alpha"): pytest.approx(brute()[1, "alpha"][2])}


def test_broadcast_part_changes_nothing(spark, monkeypatch):
    terms = spark.createDataFrame([(1, "a", 2, 5), (2, "a", 1, 9), (2, "b", 3, 9)], "rec_id bigint, term string, tf bigint, length bigint")
    totals = spark.createDataFrame([("a", 3, 5000, 99), ("b", 3, 1, 99)], "term string, n bigint, df bigint, total bigint")
    assert D.log_odds(terms, totals, 10).count() == 3


def test_current_postings(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    rows = [("Term", 1, 5, t[0]), ("term", 1, 3, t[1]), ("TERM", 1, 3, t[1]), ("gone", 1, 2, t[0]), ("gone", 1, 0, t[1]), ("null", 1, None, t[1]), (None, 1, 4, t[0]), ("x", None, 4, t[0]), ("late", 2, 7, None)]
    df = spark.createDataFrame(rows, "term string, node_id bigint, tf int, indexed_at timestamp")
    assert {(r.node_id, r.term, r.tf) for r in current_postings(df).collect()} == {(1, "term", 3), (2, "late", 7)}


def test_empty(spark):
    assert D.distinctive_in_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert D.distinctive_in_counts(spark.createDataFrame([], "rec_id bigint, term string, tf int")).count() == 0
