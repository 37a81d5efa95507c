"""The vector index against the exact search, semantic vectors against plain ones."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lithoscope.operators import retrieval, semantic, vector_index
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def _plain(rows, questions, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = []
    for q, v in questions:
        far = ((x - np.array(v, np.float32).astype(np.float64)) ** 2).sum(1)
        out += [(q, n + 1, int(ids[i])) for n, i in enumerate(np.lexsort((ids, far))[:k])]
    return sorted(out)


def test_exact_search_in_blocks(spark, vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = vector_index.exact(vectors, vectors.where("vec_id % 20 = 0"), 6, chunk_rows=70, block_questions=4)
    assert sorted((r.query, r.rank, r.id) for r in got.collect()) == _plain(rows, [r for r in rows if r[0] % 20 == 0], 6)


@pytest.mark.parametrize("chunk_rows", [40, 50_000])
def test_recall_of_the_index(spark, vectors, chunk_rows):
    """Random vectors are the hardest case: no list holds all neighbours."""
    book = vector_index.fit(vectors, parts=16, words=64)
    ix = vector_index.index(vectors, book).cache()
    assert ix.count() == vectors.count() and ix.select("list").distinct().count() > 10
    questions = vectors.where("vec_id % 20 = 0")
    true = vector_index.exact(vectors, questions, 6)
    found = vector_index.search(ix, vectors, questions, book, 6, probes=16, keep=30, chunk_rows=chunk_rows)
    assert vector_index.recall(found, true) >= 0.9
    assert vector_index.recall(vector_index.search(ix, vectors, questions, book, 6, probes=len(book.centres), keep=100), true) == 1.0
    assert [r.rank for r in found.where("query = 20").orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]


def test_clusters_a_hot_list_and_odd_rows(spark):
    """A third of the rows are one vector; nulls and other lengths are left out."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.05 * rng.normal(size=16)).tolist()) for i in range(600)] + [(1000 + i, centres[0].tolist()) for i in range(300)]
    odd = [(5000, None), (5001, [1.0]), (None, centres[1].tolist()), (5002, [float("nan")] * 16)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").withColumn("list", F.lit("x"))
    book = vector_index.fit(df, "id", "v", sample_rows=400)
    ix = vector_index.index(df, book, "id", "v").cache()
    assert ix.count() == 900
    questions = df.where("id % 50 = 0")
    true = vector_index.exact(df, questions, 5, "id", "v")
    found = vector_index.search(ix, df, questions, book, 5, probes=3, id_col="id", embedding="v", chunk_rows=30)
    assert vector_index.recall(found, true) >= 0.95
    assert sorted(r.id for r in found.where("query = 1000").collect()) == [1000, 1001, 1002, 1003, 1004]
    assert vector_index.fit(df.limit(0), "id", "v") is None and vector_index.exact(df.limit(0), questions, 5, "id", "v").count() == 0


def test_probes_and_hits_are_made_in_pieces(spark, vectors):
    """Questions are probed a few at a time, and dealt to blocks with the same answers."""

    class Book(vector_index.Codebook):
        def probes(self, q, most):
            assert len(q) * most <= 10_000
            return super().probes(q, most)

    book = vector_index.fit(vectors, parts=16, words=64)
    book = Book(book.centres, book.words)
    ix = vector_index.index(vectors, book).cache()
    big = vectors.unionByName(vectors.withColumn("vec_id", F.col("vec_id") + 10_000)).coalesce(1)
    every = lambda **kw: sorted(map(tuple, vector_index.search(ix, vectors, big, book, 6, probes=len(book.centres), keep=3, **kw).collect()))
    got = every(block_questions=70)
    assert len(got) == 12 * vectors.count() and got == every()


def test_words():
    want = {"getHTTPResponse_code x2": ["get", "http", "response", "code", "x2"], "Ünï-ΣΑ": ["ünï", "σα"], None: []}
    from pyspark.sql import SparkSession

    df = SparkSession.active().createDataFrame([(k,) for k in want], "t string")
    assert {r[0]: r[1] for r in df.select("t", semantic.words("t")).collect()} == want


def _corpus():
    """Topics of words that occur together, of which each chunk has a few."""
    rng, topics = np.random.default_rng(8), {t: [f"{t}{i}" for i in range(12)] for t in ("disk", "user", "mail", "graph", "color")}
    rows = []
    for n in range(300):
        t = list(topics)[n % 5]
        rows.append((n, " ".join([*rng.choice(topics[t], 4, replace=False), *(f"noise{rng.integers(40)}" for _ in range(2)), "the"])))
    return rows


def _plain_rows(rows):
    count = {i: Counter(re.findall(r"[a-z0-9]+", t)) for i, t in rows}
    df = Counter(w for c in count.values() for w in c)
    known = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items() if 1 < n <= len(rows) / 2}
    out = {}
    for i, c in count.items():
        w = {x: (1 + math.log(n)) * known[x] for x, n in c.items() if x in known}
        length = math.sqrt(sum(v * v for v in w.values()))
        out[i] = {x: v / length for x, v in w.items()}
    return out


def test_vectors_span_the_strongest_directions(spark):
    """Against a dense singular value decomposition."""
    rows = _corpus()
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    plain = _plain_rows(rows)
    counted = semantic.counts(df)
    got = defaultdict(dict)
    for r in semantic.weights(counted, semantic.vocabulary(counted)).collect():
        got[r.id][r.word] = r.a
    assert got.keys() == plain.keys() and all(got[i].keys() == plain[i].keys() and all(abs(got[i][w] - a) < 1e-9 for w, a in x.items()) for i, x in plain.items())
    model = {r.word: np.array(r.v) for r in semantic.fit(df, dims=12, rounds=4).collect()}
    names = sorted(model)
    a = np.array([[plain[i].get(w, 0) for w in names] for i in sorted(plain)])
    v = np.array([model[w] for w in names])
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-6)
    best = np.linalg.svd(a, compute_uv=False)
    assert np.linalg.norm(a @ v) ** 2 >= 0.97 * (best[:12] ** 2).sum()
    assert np.linalg.norm(a @ v[:, :5]) ** 2 >= 0.98 * (best[:5] ** 2).sum()  # the strongest first


def test_questions_find_chunks_without_their_words(spark):
    """Of each question's nearest chunks that share none of its words, how many are of its topic."""
    rows = _corpus()
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    model = semantic.fit(df, dims=8)
    mine = {r.chunk_id: r.embedding for r in semantic.embed(df, model).collect()}
    hashed = retrieval.HashingEmbedder()
    right = {"semantic": 0, "hashed": 0}
    for t in ("disk", "user", "mail", "graph", "color"):
        question = f"{t}1 {t}2 {t}3"
        q = semantic.embed(spark.createDataFrame([(0, question)], "chunk_id long, text string"), model).first().embedding
        others = [(i, x) for i, x in rows if not set(question.split()) & set(x.split())]
        for kind, near in (("semantic", lambda i, x: np.dot(q, mine[i])), ("hashed", lambda i, x: float(hashed.embed([question])[0] @ hashed.embed([x])[0]))):  # noqa: B023
            top = sorted(others, key=lambda r: -near(*r))[:10]
            right[kind] += sum(t in x for _, x in top)
    assert right["semantic"] >= 45 and right["semantic"] > 1.5 * right["hashed"]


def test_semantic_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "a b a"), (2, "b c"), (3, "zz"), (4, "b a")], "chunk_id long, text string").withColumn("word", F.lit("x"))
    model = semantic.fit(df, dims=4, most_share=1.0)
    assert {r.word for r in model.collect()} == {"a", "b"}
    got = {r.chunk_id: r.embedding for r in semantic.embed(df, model).collect()}
    assert got.keys() == {1, 2, 3, 4} and got[1] is None and got[3] is None and abs(sum(x * x for x in got[2]) - 1) < 1e-6
    assert semantic.embed(df, semantic.fit(df.limit(0), dims=4)).where("embedding IS NOT NULL").count() == 0


def test_blocks_and_parts_do_not_show(spark):
    """Small blocks and parts, ids that repeat over many batches: the same vectors as at once, up to a turn."""
    rows = [*_corpus(), *[(7, f"disk{i % 12} user{i % 5}") for i in range(1200)]]
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    cut = semantic.blocks(df, block_rows=50).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(i for r in cut for i in r.ids) == list(range(300)) and sum(r.full for r in cut) == 300
    assert all(r.words == sorted(r.words) for r in cut) and len(cut) > spark.sparkContext.defaultParallelism * 2
    df7 = {w: n for r in cut if 7 in r.ids for w, n in zip(r.words, r.df, strict=True)}
    assert {w for w in df7 if w[:4] in ("disk", "user")} >= {f"disk{i}" for i in range(12)}
    found = []
    for kw in ({}, {"block_rows": 50, "part_rows": 40}):
        model, own = semantic.fit_embed(df, dims=8, **kw)
        own = {r.chunk_id: r.embedding for r in own.collect()}
        asked = {r.chunk_id: r.embedding for r in semantic.embed(df, model).collect()}
        assert own.keys() == asked.keys() and np.allclose([own[i] for i in sorted(own)], [asked[i] for i in sorted(own)], atol=1e-5)
        x = np.array([own[i] for i in sorted(own)])
        found.append(x @ x.T)
    assert np.allclose(*found, atol=1e-4)


def _most_shuffled(spark, since):
    """The rows that a stage from that number on has shuffled, at most; the number of the next."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    empty = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), empty)
    rows = [(s.stageId(), s.shuffleWriteRecords()) for s in (stages.apply(i) for i in range(stages.size()))]
    return max([0, *(n for i, n in rows if i >= since)]), max(i for i, _ in rows) + 1


def test_words_are_not_shuffled_for_each_chunk(spark):
    """40 of 150 words in each of 2000 chunks: what moves is chunks, and words of blocks."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{j}" for j in rng.choice(150, 40, replace=False))) for i in range(2000)]
    df = spark.createDataFrame(rows, "chunk_id long, text string").cache()
    df.count()
    _, since = _most_shuffled(spark, 0)
    model = semantic.fit(df, dims=4)
    assert semantic.embed(df, model).where("embedding IS NOT NULL").count() == 2000
    assert 0 < _most_shuffled(spark, since)[0] <= 2 * spark.sparkContext.defaultParallelism * 150
