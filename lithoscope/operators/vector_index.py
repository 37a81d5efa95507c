"""Nearest vectors for many questions: exactly, or by an inverted file.

The index is a table.  A codebook is fitted on a bounded sample of the vectors: coarse
centres, and for each of some parts of a vector a few code words of what is left after
the centre (product quantisation).  Every vector, not only the sample, becomes a row: its
list and a code word's number for each part.  A question probes the lists of its nearest
centres by a join; members are ranked by their code words, and the best of them by their
own vectors.  The exact search compares every question with every vector, in blocks.

Lists are as long as they come: both searches deal rows to tasks by list and a salt, so
that a list that a third of all vectors fall into is searched by many tasks.  The questions
of a list are dealt to blocks as well: what a task holds does not grow with either.

Defined cases: vectors that are null or of another length than most are left out of the
sample, the index and the searches; equal distances are in order of id; repeated rows
repeat; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import ship

_HITS = "query long, id long, distance double"
#: About so many rows leave a function at a time.
_ROWS = 10_000


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


def _cut(batch: pa.RecordBatch, rows: int):
    """A batch in pieces of `rows` rows, one at least."""
    rows = max(1, rows)
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the rows of x; a centre that loses all rows takes the row that is worst off."""
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at, far = _nearest_centre(x, centres)
        count = np.bincount(at, minlength=k)
        total = np.zeros_like(centres, np.float64)
        np.add.at(total, at, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres).astype(np.float32)
        for lost in np.flatnonzero(count == 0):
            worst = int(far.argmax())
            centres[lost], far[worst] = x[worst], -1
    return centres


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, far = np.empty(len(x), np.int64), np.empty(len(x))
    own = (centres.astype(np.float64) ** 2).sum(1)
    for i in range(0, len(x), 4096):
        b = x[i : i + 4096].astype(np.float64)
        d = own - 2 * b @ centres.T
        at[i : i + 4096] = j = d.argmin(1)
        far[i : i + 4096] = d[np.arange(len(b)), j] + (b**2).sum(1)
    return at, far


@dataclass
class Codebook:
    """centres: one row a list; words: part, number, values."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """list and code of each row of x."""
        at, _ = _nearest_centre(x, self.centres)
        left = (x - self.centres[at]).reshape(len(x), len(self.words), -1)
        code = np.stack([_nearest_centre(left[:, p], w)[0] for p, w in enumerate(self.words)], 1)
        return at, code.astype(np.uint8)

    def probes(self, q: np.ndarray, most: int) -> np.ndarray:
        """The lists of the centres nearest to each row of q."""
        d = (self.centres.astype(np.float64) ** 2).sum(1) - 2 * q.astype(np.float64) @ self.centres.T
        return np.argsort(d, 1, kind="stable")[:, :most]

    def distances(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of a list's codes from q, by a table of each part's words."""
        left = (q - self.centres[at]).reshape(len(self.words), 1, -1)
        table = ((left - self.words) ** 2).sum(2)
        return table[np.arange(len(self.words)), codes].sum(1)


def _clean(vectors: DataFrame, id_col: str, embedding: str, dims: int | None) -> DataFrame:
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, e -> e IS NULL OR isnan(e))")
    return x if dims is None else x.where(F.size("v") == dims)


def dimensions(vectors: DataFrame, embedding: str = "embedding") -> int | None:
    """The length that most vectors have."""
    row = vectors.where(F.size(embedding) > 0).groupBy(F.size(embedding).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return row["n"] if row else None


def fit(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", lists: int | None = None, parts: int = 16, words: int = 256, sample_rows: int = 20_000, rounds: int = 12, seed: int = 5) -> Codebook | None:
    """A codebook from the `sample_rows` vectors whose ids have the smallest hashes: at most
    that many vectors come to the driver.  `lists` is by default the root of the number of
    vectors, at most 1024; `parts` is lowered to a divisor of the dimensions."""
    dims = dimensions(vectors, embedding)
    if not dims:
        return None
    x = _clean(vectors, id_col, embedding, dims)
    n = x.count()
    if not n:
        return None
    rows = x.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()
    sample, rng = _matrix(rows.column("v"), dims), np.random.default_rng(seed)
    centres = _kmeans(sample, lists or max(1, min(1024, round(n**0.5))), rounds, rng)
    at, _ = _nearest_centre(sample, centres)
    parts = max(p for p in range(1, parts + 1) if dims % p == 0)
    left = (sample - centres[at]).reshape(len(sample), parts, -1)
    size = min(words, len(sample), 256)
    return Codebook(centres, np.stack([_kmeans(left[:, p], size, rounds, rng) for p in range(parts)]))


def index(vectors: DataFrame, book: Codebook, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, list, code of every vector; write it partitioned or sorted by list.  The codebook
    goes along with the code: lists x dims and parts x words x dims / parts numbers."""
    ship(vectors.sparkSession)

    def run(batches):
        for b in batches:
            at, code = book.encode(_matrix(b.column("v"), book.dims)) if b.num_rows else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "list", "code"])

    return _clean(vectors, id_col, embedding, book.dims).mapInArrow(run, "id long, list int, code binary")


def _best(ids: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least, equal ones by id."""
    if len(far) > k:
        edge = np.partition(far, k - 1)[k - 1]
        near = np.flatnonzero(far <= edge)
    else:
        near = np.arange(len(far))
    return near[np.lexsort((ids[near], far[near]))[:k]]


def _hits(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    q = np.concatenate([np.zeros(0, np.int64), *[np.full(len(i), k, np.int64) for k, i, _ in rows]])
    ids = np.concatenate([np.zeros(0, np.int64), *[i for _, i, _ in rows]])
    far = np.concatenate([np.zeros(0), *[d for _, _, d in rows]])
    return pa.table({"query": q, "id": ids, "distance": far})


def _top(hits: DataFrame, k: int) -> DataFrame:
    """query, rank, id, distance; each task keeps its own k before any row is shuffled."""
    w = Window.partitionBy("query").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "distance")


def _salted(rows: DataFrame, chunk_rows: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """rows with a salt, and for each key how many salts it has."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("salts"))
    return rows.join(sizes, list(keys)).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts"), sizes


def search(index: DataFrame, vectors: DataFrame, questions: DataFrame, book: Codebook, k: int = 6, probes: int = 8, keep: int = 20, id_col: str = "vec_id", embedding: str = "embedding", chunk_rows: int = 50_000, block_questions: int = 1000) -> DataFrame:
    """query, rank, id, distance: for each question the k best of the `keep * k` members of
    its lists whose codes are nearest, by their vectors' own distances.  A group holds about
    `block_questions` questions and `chunk_rows` members of a list at most."""
    ship(vectors.sparkSession)

    def probed(batches):
        for b in (x for whole in batches for x in _cut(whole, _ROWS // probes)):
            q = _matrix(b.column("v"), book.dims)
            at = book.probes(q, probes)
            n = at.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").to_numpy(), n)), b.column("v").take(pa.array(np.repeat(np.arange(len(q)), n))), pa.array(at.reshape(-1).astype(np.int32))], names=["query", "q", "list"])

    def ranked(key, asked: pa.Table, members: pa.Table) -> pa.Table:
        ids, out = members.column("id").to_numpy(), []
        if not len(ids):
            return _hits(out)
        codes = np.frombuffer(b"".join(members.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        for query, q in zip(asked.column("query").to_pylist(), _matrix(asked.column("q"), book.dims), strict=True):
            far = book.distances(q, key[0].as_py(), codes)
            best = _best(ids, far, keep * k)
            out.append((query, ids[best], far[best].astype(np.float64)))
        return _hits(out)

    q = _clean(questions, id_col, embedding, book.dims).distinct()
    members, sizes = _salted(index, chunk_rows, "list")
    asked = q.mapInArrow(probed, "query long, q array<float>, list int")
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / block_questions).cast("int").alias("blocks"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = asked.join(sizes.join(blocks, "list"), "list").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("salt", every("salts")).drop("salts", "blocks")
    members = members.join(blocks, "list").withColumn("block", every("blocks")).drop("blocks")
    hits = asked.groupBy("list", "salt", "block").cogroup(members.groupBy("list", "salt", "block")).applyInArrow(ranked, _HITS)
    near = _top(hits, keep * k).select("query", "id")
    own = _clean(vectors, id_col, embedding, book.dims)
    near = near.join(own.distinct(), "id").join(q.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    gap = F.zip_with("v", "q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return _top(near.select("query", "id", F.aggregate(gap, F.lit(0.0), lambda s, d: s + d).alias("distance")), k)


def exact(vectors: DataFrame, questions: DataFrame, k: int = 6, id_col: str = "vec_id", embedding: str = "embedding", chunk_rows: int = 20_000, block_questions: int = 1000) -> DataFrame:
    """query, rank, id, distance: every question against every vector, a block of questions
    and a chunk of vectors at a time."""
    ship(vectors.sparkSession)
    dims = dimensions(vectors, embedding) or 0
    v, q = _clean(vectors, id_col, embedding, dims), _clean(questions, id_col, embedding, dims).distinct()
    chunks, blocks = (max(1, -(-x.count() // n)) for x, n in ((v, chunk_rows), (q, block_questions)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))

    def compared(_, asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids, x, out = rows.column("id").to_numpy(), _matrix(rows.column("v"), dims).astype(np.float64), []
        for query, y in zip(asked.column("id").to_pylist(), _matrix(asked.column("v"), dims).astype(np.float64), strict=True):
            far = ((x - y) ** 2).sum(1)
            best = _best(ids, far, k)
            out.append((query, ids[best], far[best]))
        return _hits(out)

    return _top(q.groupBy("chunk", "block").cogroup(v.groupBy("chunk", "block")).applyInArrow(compared, _HITS), k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true neighbours that were found."""
    n = true.count()
    return true.join(found, ["query", "id"], "left_semi").count() / n if n else 1.0
