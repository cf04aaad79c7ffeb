import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectrail.llm import bagminhash as B
from vectrail.llm import near_duplicates as N
from vectrail.llm.components import components
from vectrail.llm.records import tokens

SCHEMA = "doc_id bigint, text string, rec_id string, key int, n string"


def sentence(seed, n=120):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 500, n)]


def test_signature_is_unbiased():
    r = np.random.default_rng(0)
    a = r.integers(1, 9, 200).astype(float)
    b = a.copy()
    b[:80] = r.integers(1, 9, 80)
    f = B.mix(np.arange(200, dtype=np.uint64))
    s = B.signatures(np.repeat([0, 1], 200), np.r_[f, f], np.r_[a, b], 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=30), st.integers(1, 40))
@settings(max_examples=20, deadline=None)
def test_signature_does_not_depend_on_the_batch(weights, m):
    w = np.array(weights)
    f = B.mix(np.arange(len(w), dtype=np.uint64))
    alone = B.signatures(np.zeros(len(w), int), f, w, 1, m)[0]
    twice = B.signatures(np.repeat([0, 1], len(w)), np.r_[f, f], np.r_[w, w], 2, m)
    assert (twice[0] == alone).all() and (twice[1] == alone).all()


def test_packing_of_features():
    f, c = N.shingles(tokens("one two three one two three one two three four"), 3, N._Hashes())
    packed, counts = N.pack(f, c)
    assert (N.unpack(packed) == f).all() and (np.frombuffer(counts, "<u4") == c).all() and c.max() > 1


def brute(texts, k, least, similarity):
    sets = {}
    for i, t in texts.items():
        w = tokens(t)
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        if len(s) >= least:
            sets[i] = s
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_pairs_match_brute_force_with_nulls_copies_and_clashing_columns(spark):
    texts = {}
    for g in range(12):
        base = sentence(g)
        texts[10 * g] = " ".join(base)
        texts[10 * g + 1] = " ".join(base)  # a copy
        edited = list(base)
        for p in range(0, 120, 17):
            edited[p] = f"x{p}"
        texts[10 * g + 2] = " ".join(edited)
        texts[10 * g + 3] = " ".join(base[60:] + base[:60])  # rearranged
        texts[10 * g + 4] = " ".join(sentence(100 + g))
    rows = [(i, t, "clash", 1, "n") for i, t in texts.items()] + [(900, None, None, None, None), (901, "", "", 0, ""), (902, "too short", "", 0, ""), (None, "no id at all", "", 0, ""), (0, texts[0], "again", 1, "n")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = N.expanded(*N.similar_texts(docs, k=3, similarity=0.6, least=40, counted=False, n_bands=40, rows=4))
    got = [(r.id_a, r.id_b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, 3, 40, 0.6)


def test_multiset_overlap_counts_repetitions(spark):
    once, often = "a b c d e f g h i j".replace(" ", "1 ") + "1", None
    often = " ".join([once] * 6)
    docs = spark.createDataFrame([(1, once), (2, often), (3, once)], "doc_id bigint, text string")
    pairs, members = N.similar_texts(docs, k=3, similarity=0.8)
    assert pairs.count() == 0 and {(r.rec_id, r.rep) for r in members.collect()} == {(1, 1), (3, 1)}


def test_copies_are_paired_in_full(spark):
    """Classes of 33 and of 1000 copies, each with an edited text: every pair the definition gives."""
    rows, base = [], 0
    for n, seed in ((33, 1), (1000, 2)):
        text, other = " ".join(sentence(seed)), " ".join(sentence(seed)[:-3])
        rows += [(base + i, text) for i in range(n)] + [(base + n, other)]
        base += 5000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = N.similar_texts(docs, k=3, similarity=0.6, counted=False)
    pairs = N.expanded(*found)
    assert pairs.where("id_b < 5000").count() == 34 * 33 // 2 and pairs.where("id_a >= 5000").count() == 1001 * 1000 // 2 == pairs.count() - 34 * 33 // 2
    assert pairs.where("id_a >= id_b").count() == 0 and pairs.distinct().count() == pairs.count()
    rows = {r.rec_id: (r.class_id, r.class_size, r.links) for r in N.class_rows(*found).collect()}
    assert len(rows) == 34 + 1001 and rows[0] == rows[32] == (0, 33, 1) and rows[33] == (33, 1, 1) and rows[5999] == (5000, 1000, 1)


def test_classes_beyond_the_bound_come_out_as_a_star(spark):
    text, other = " ".join(sentence(1)), " ".join(sentence(1)[:-3])
    docs = spark.createDataFrame([(i, text) for i in range(100)] + [(500, other)], "doc_id bigint, text string")
    found = {(r.id_a, r.id_b) for r in N.expanded(*N.similar_texts(docs, k=3, similarity=0.6, counted=False), most=99).collect()}
    assert found == {(0, i) for i in range(1, 100)} | {(0, 500)}
    groups = {r.doc_id: r.group_id for r in N.groups(docs).collect()}
    assert set(groups.values()) == {0} and len(groups) == 101


def test_hot_bands_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    reps = spark.createDataFrame([(i, [7, 1000 + i]) for i in range(30)], "rep bigint, bands array<bigint>")
    assert {(r.id_a, r.id_b) for r in N.candidates(reps).collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def test_vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 64)).astype(np.float32)
    x = np.concatenate([x, x[:20] * 3, x[:20] + 0.05 * r.normal(size=(20, 64)), x[:5]]).astype(np.float32)
    v = spark.createDataFrame([(i, [float(y) for y in e]) for i, e in enumerate(x)], "rec_id bigint, embedding array<float>")
    found = {(p.id_a, p.id_b) for p in N.expanded(*N.similar_vectors(v)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T
    assert found == {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if s[a, b] >= 0.98}


def at_cosine(x, cosine, r):
    """Unit vectors along x, and for each another at the given cosine, in a random direction."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    n = r.normal(size=x.shape)
    n -= (n * u).sum(1)[:, None] * u
    return u, cosine * u + (1 - cosine**2) ** 0.5 * n / np.linalg.norm(n, axis=1)[:, None]


def recall_at_threshold(spark, x, r):
    a, b = at_cosine(x, 0.98001, r)
    rows = [(i, e.tolist()) for i, e in enumerate(np.concatenate([a, b]))]
    v = spark.createDataFrame(rows, "rec_id bigint, embedding array<float>")
    found = {(p.id_a, p.id_b) for p in N.expanded(*N.similar_vectors(v)).collect()}
    return np.mean([(i, i + len(x)) in found for i in range(len(x))])


def test_bands_reach_pairs_at_the_threshold(spark):
    r = np.random.default_rng(6)
    assert recall_at_threshold(spark, r.normal(size=(2000, 64)), r) >= 0.9985


@pytest.mark.parametrize("shape", ["heavy tails", "one axis", "sparse"])
def test_bands_do_not_depend_on_the_shape_of_vectors(spark, shape):
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 64))
    if shape == "heavy tails":
        x = r.standard_cauchy((500, 64))
    elif shape == "one axis":
        x[:, 0] = 20
    else:
        x *= np.argsort(r.random((500, 64)), 1) < 8
    assert recall_at_threshold(spark, x, r) >= 0.995


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert N.expanded(*N.similar_texts(docs)).count() == 0 and N.groups(docs).count() == 0
    assert N.class_rows(*N.similar_texts(docs)).count() == 0
    assert N.expanded(*N.similar_vectors(spark.createDataFrame([], "rec_id bigint, embedding array<float>"))).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(1, 1)], [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, None)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "id_a bigint, id_b bigint")).collect()}
    want = {}
    for a, b in edges:
        if b is not None and a != b:
            want.setdefault(a, a)
            want.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
