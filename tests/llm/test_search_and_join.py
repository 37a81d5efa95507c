"""Ranked search and the parity-sketch join against plain versions."""

import random

import numpy as np
import pytest
from lithoscope.llm import parity_join, ranked_search
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_contracts import ODD, SF, _by_id, _docs, docs, odd, table  # noqa: F401

ITEMS = [(1, "a line long enough"), (2, "one TWO three"), (3, None), (4, ""), (5, "naïve 日本語 tail tail tail"), (6, "unheard-of"), (1, "a line long enough"), (1, "template t3 t4 own7"), (None, "repeated copy of one text")]


def _items(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, term string, shard int")


@pytest.mark.parametrize("sizes", [(200, 7, 1000), (16 << 20, 1 << 16, 2)])
def test_ranked_search(spark, docs, sizes):  # noqa: F811
    """Small and large shards, one and several blocks of items."""
    ix = ranked_search.index(docs, shard_bytes=sizes[0], shard_docs=sizes[1])
    got = ranked_search.search(ix, _items(spark), 5, block_items=sizes[2])
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute.ranked(_docs(docs), ITEMS[:8], 5) + brute.ranked(_docs(docs), ITEMS[8:], 5), key=key)


def test_ranked_benchmark(spark, table):  # noqa: F811
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = ranked_search.ranked_search(table, items)
    want = brute.ranked(_docs(table), [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_merge_by_place_equals_sums():
    """The heap merge with lists that leave it, also with equal scores."""
    rng = random.Random(5)
    for _ in range(300):
        lists = []
        for _ in range(rng.randint(0, 8)):
            x = ranked_search._List.__new__(ranked_search._List)
            x.at = sorted(rng.sample(range(60), rng.randint(1, 50)))
            x.part = [rng.randint(1, 4) for _ in x.at]
            x.most = max(x.part)
            lists.append((rng.choice((1, 1, 3, 40)), x))
        sums = {}
        for w, x in lists:
            for p, s in zip(x.at, x.part, strict=True):
                sums[p] = sums.get(p, 0) + w * s
        assert sorted((-s, p) for s, p in ranked_search.best(lists, 5)) == sorted((-s, p) for p, s in sums.items())[:5]


def test_packed_numbers():
    runs = [[0], [255], [256, 1], [3, 1 << 40], [7, 8, 9], [1 << 16]]
    starts = np.cumsum([0, *map(len, runs[:-1])])
    assert [ranked_search.unpacked(x).tolist() for x in ranked_search.packed(np.array(sum(runs, [])), starts)] == runs


def test_search_of_nothing(spark, table):  # noqa: F811
    assert ranked_search.ranked_search(table.limit(0), _items(spark)).collect() == []
    assert ranked_search.ranked_search(table, _items(spark).limit(0)).collect() == []
    twice = spark.createDataFrame([(7, "some words"), (7, "some words"), (None, "some"), (None, None)], "doc_id long, text string")
    got = ranked_search.ranked_search(twice, spark.createDataFrame([(1, "words"), (2, "some")], "item_id long, text string")).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got) if r.item_id == 1] == [(1, 7), (2, 7)]


@pytest.mark.parametrize(("limit", "long"), [((90, 100), 16), ((90, 100), 3), ((80, 100), 2), ((50, 100), 2)])
def test_join(docs, limit, long, monkeypatch):  # noqa: F811
    monkeypatch.setattr(parity_join, "LONG", long)
    out = parity_join.jaccard_join(docs, shingle=3, limit=limit)
    assert _by_id(out, "n_shingles", "component_id") == {d: x[:2] for d, x in brute.near(_docs(docs), 3, *limit).items()}


def _near_texts(rng, groups, size, copies):
    """Groups of texts of about `size` words, of which each changes a few words of another one of its group."""
    out = []
    for g in range(groups):
        made = [[f"g{g}w{i}" for i in range(size)]]
        for _ in range(copies):
            t = list(rng.choice(made))
            for _ in range(rng.randint(0, max(1, size // 40))):
                t[rng.randrange(len(t))] = f"x{rng.random()}"
            made.append(t[rng.randint(0, 1) if len(t) > 3 else 0 :])
        out += [" ".join(t) for t in made]
    return out


@pytest.mark.parametrize("long", [2, 16])
def test_join_of_chains(spark, long, monkeypatch):
    """Chains of near copies of many sizes, also of few words, in short and long lists."""
    monkeypatch.setattr(parity_join, "LONG", long)
    rng = random.Random(11)
    texts = [t for size in (4, 12, 25, 60, 150, 700) for t in _near_texts(rng, 4, size, 25)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    out = parity_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, limit=(90, 100))
    want = {d: x[:2] for d, x in brute.near(rows, 3, 90, 100).items()}
    assert _by_id(out, "n_shingles", "component_id") == want
    assert 10 < len({x[1] for x in want.values()}) < len(rows) - 100


def test_pigeonhole_holds():
    """Every pair at the limit shares a key, whatever its size; the distance never exceeds the difference."""
    rng = np.random.default_rng(3)
    rare = 0
    for num in (80, 90, 95):
        bands = parity_join.Bands(num, 100)
        for _ in range(1500):
            n = int(rng.integers(1, 400))
            s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            most = (n * (100 - num)) // (100 + num)
            t = np.unique(np.concatenate((s[rng.permutation(n)[most // 2 :]], rng.integers(0, 1 << 63, most).astype(np.uint64))))
            both = len(np.intersect1d(s, t))
            if 100 * both < num * (len(s) + len(t) - both):
                continue
            (a, x), (b, y) = parity_join.keys_of(s, bands), parity_join.keys_of(t, bands)
            if not np.array_equal(s, t):
                assert len(np.intersect1d(x, y)), (n, most)
            far = parity_join.distance(bands, (len(s), len(t)), tuple(k[0].tobytes() for k in (a, b)), tuple((k + [np.zeros(0)])[1].tobytes() for k in (a, b)))
            assert far is not None and far <= len(s) + len(t) - 2 * both <= bands.apart(len(s) + len(t))
            rare += 1
    assert rare > 2000


def test_join_of_odd_ids_and_nothing(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "e f g h"), (9, "E F G H"), (None, "e f g h"), (3, None), (4, " "), (5, "a b")], "doc_id long, text string").withColumn("node", F.lit("x"))
    got = sorted(((r.doc_id or 99, r.n_shingles, r.component_id) for r in parity_join.jaccard_join(df, shingle=3).collect()))
    assert got == [(3, 0, 3), (4, 0, 4), (5, 1, 5), (7, 2, 7), (7, 2, 7), (9, 2, 7), (99, 2, 7)]
    assert parity_join.jaccard_join(df.limit(0)).collect() == []
