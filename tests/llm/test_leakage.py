import numpy as np
import pytest

from vectrail.llm import leakage as L

ITEM = "Every hour Tidegudi receives 55829 oars and rejects each of the 42 silent ones before writing 84190 lines to Toponona"
OTHER = "Solve step by step how Kogebe merges a hollow shelf of weight 38277 with a patient shelf of weight 86562 and then reads aloud"


@pytest.mark.parametrize(
    "text",
    [
        ITEM.upper(),
        "noise before " + " ".join(ITEM.split()[3:16]) + " noise after",
        ITEM.replace(" ", "&nbsp;"),
        "<p>" + ITEM.replace("silent", "<b>si</b>lent") + "</p>",
        ITEM.replace("receives", "re-\nceives").replace("silent", "si­​lent"),
        ITEM.replace("oars", "ｏａｒｓ").replace("hour", "**hour**,"),
    ],
)
def test_readers_see_the_same_words(spark, text):
    docs = spark.createDataFrame([(1, text, "clash")], "doc_id bigint, text string, words string")
    items = spark.createDataFrame([(7, ITEM), (8, OTHER)], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()] == [(1, 7)]


def test_eleven_words_and_scattered_words_are_no_leak(spark):
    words = ITEM.split()
    rows = [(1, "x " + " ".join(words[:11]) + " y"), (2, " ".join(reversed(words))), (3, None), (4, ""), (None, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (None, OTHER), (7, ITEM)], "item_id bigint, text string")
    assert L.leaks(docs, items).count() == 0


def test_long_stretches_lose_nothing_at_window_edges(spark):
    r = np.random.default_rng(0)
    items = [(i, " ".join(f"v{x}" for x in r.integers(0, 60, 30))) for i in range(30)]
    docs = []
    for d in range(40):
        filler = [f"v{x}" for x in r.integers(0, 60, 90)]
        at, item = int(r.integers(0, 90)), int(r.integers(0, 30))
        start = int(r.integers(0, 18))
        docs.append((d, item, " ".join(filler[:at] + items[item][1].split()[start : start + 12] + filler[at:])))
    df = spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id bigint, text string")
    found = {(x.doc_id, x.item_id) for x in L.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(d, i) for d, i, _ in docs} <= found


def test_a_run_beside_words_of_another_item_is_retrieved(spark):
    docs = spark.createDataFrame([(1, " ".join(ITEM.split()[3:15] + OTHER.split()))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (8, OTHER)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()} == {(1, 7), (1, 8)}


def test_paraphrase(spark):
    changed = ITEM.replace("receives", "gets").replace("rejects", "refuses").replace("silent", "quiet")
    docs = spark.createDataFrame([(1, changed)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (8, OTHER)], "item_id bigint, text string")
    assert L.leaks(docs, items).count() == 0
    row = L.leaks(docs, items, gap=2).where("lcs >= 15").first()
    assert (row.item_id, row.lcs) == (7, 17)


def test_paraphrases_are_compared_over_the_whole_stretch(spark):
    """Words in common that no window holds: spread by changed words over an edge, and those of an item of 140 words."""
    r = np.random.default_rng(3)
    items = [(i, [f"i{i}x{x}" for x in range(30)]) for i in range(20)] + [(20, [f"long{x}" for x in range(140)])]
    docs = []
    for d in range(60):
        of = items[d % 20][1]
        filler = [w for j in r.integers(0, 20, 20) for w in items[(d + 1 + j % 19) % 20][1][:6]]
        at = int(r.integers(0, len(filler)))
        changed = [x for k, w in enumerate(of[:24]) for x in (("other", w) if k % 3 == 0 else (w,))]
        docs.append((d, d % 20, " ".join(filler[:at] + changed + filler[at:])))
    docs.append((60, 20, " ".join("other" if x % 4 == 3 else w for x, w in enumerate(items[20][1]))))
    df = spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id bigint, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in L.leaks(df, table, least=15, gap=2).where("lcs >= 15 and answer >= 0.5").collect()}
    assert {(d, i) for d, i, _ in docs} <= set(got)
    assert all(got[d, i].lcs >= 24 for d, i, _ in docs) and got[60, 20].lcs == 105


def test_thinly_spread_words_are_candidates(spark):
    """Half of an item's telling words between words of others, so that no window has a high cosine with it."""
    item = [f"t{x}" for x in range(30)]
    others = [(i, [f"o{i}x{x}" for x in range(30)]) for i in range(1, 40)]
    text = [w for k in range(20) for w in (item[k], *others[k][1][:14])]
    df = spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in [(0, item), *others]], "item_id bigint, text string")
    row = L.leaks(df, table, least=15, gap=2).where("item_id = 0").first()
    assert row.lcs == 20 and row.answer > 0.6


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert L.leaks(docs, items).count() == L.leaks(docs, some).count() == 0


def test_longest_common():
    a, b = np.array([1, 2, 3, 4, -1, 5]), np.array([9, 2, 3, 7, 4, 5, -1])
    assert (L.longest_run(a, b), L.longest_subsequence(a, b)) == (2, 4)


def test_singular_vectors(spark):
    """Against a dense decomposition of the same matrix."""
    r = np.random.default_rng(1)
    rows = [r.integers(0, 30, 12).astype(np.int32) for _ in range(80)]
    idf = 1 + r.random(30)
    table = spark.createDataFrame([([int(x) for x in w],) for w in rows[:60]], "words array<int>")
    got = L.right_singular(table, rows[60:], idf, 30)
    dense, _ = L._Weights(idf).project(rows, np.eye(30))
    values = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(np.linalg.norm(dense @ got, axis=0), values, atol=1e-6)
