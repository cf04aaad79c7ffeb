import numpy as np
import pytest

from vectrail.llm import packing as P


def packed(spark, sizes, capacity, **how):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "item_id bigint, size bigint")
    return P.harmonic_pack(df, capacity, **how).collect()


@pytest.mark.parametrize("top_up", [0, 1, 3])
def test_every_item_once_and_no_bin_overfull(spark, top_up):
    r = np.random.default_rng(1)
    sizes = [int(s) for s in r.lognormal(4.5, 1.2, 800)] + [0, None, 256, 257, 5000, 512]
    rows = packed(spark, sizes, 256, top_up=top_up)
    bins, items = {}, {}
    for x in rows:
        bins[x.bin_id] = bins.get(x.bin_id, 0) + x.size
        items.setdefault(x.item_id, []).append((x.part, x.size))
    assert max(bins.values()) <= 256
    for i, s in enumerate(sizes):
        parts = sorted(items.get(i, []))
        assert sum(p[1] for p in parts) == (s or 0) and [p[0] for p in parts] == list(range(len(parts)))
        if s and s <= 256:
            assert len(parts) == 1
    if top_up == 3:
        assert sum(bins.values()) / len(bins) / 256 > 0.8


def test_fixed_counts_in_a_class(spark):
    rows = packed(spark, [30] * 10, 100, top_up=0)
    assert sorted(list(map([r.bin_id for r in rows].count, {r.bin_id for r in rows}))) == [1, 3, 3, 3]


def test_ranks_do_not_need_one_task(spark):
    df = spark.createDataFrame([(i, 0, 1, "k" if i % 3 else "l") for i in range(100)], "item_id bigint, part int, size bigint, key string")
    got = P.ranked(df, "key", "r", 7).collect()
    for k in "kl":
        ranks = sorted(x.r for x in got if x.key == k)
        assert ranks == list(range(len(ranks)))


def test_empty_and_texts(spark):
    assert packed(spark, [], 10) == []
    docs = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (4, "a b " * 3000, 5)], "doc_id bigint, text string, size int")
    rows = P.packed_texts(docs, 1000).collect()
    assert {r.item_id for r in rows} == {1, 4} and max(r.size for r in rows) == 1000
