"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort
places equal texts next to each other, and each row is compared in full with its
neighbour.  The sort key begins with the first bytes of the text, then its digest,
then the text itself and the row's rank, so that splitters stay small, and a group
of copies that holds a third of all rows is cut over many partitions by the rank.
The runs at the partitions' ends (two a partition at most) are grouped again by their
whole texts; which of them belong together, without the texts, comes to the driver: their
number depends on the number of partitions, not on the data.

Equal: identical after deleting `[\\x20\\x09-\\x0D]`.  Of equal texts stays the row
with the most code points, then the smallest id, then the first of equal rows.

Defined cases: null counts as an empty text and empty texts are equal; a null id
sorts last; rows that repeat an id are rows of their own, of which one stays; an id that
is no number is refused by the cast to long; a very long text is one row, of which
a task holds two; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

_OUT = "_k long, _n long, sha string, part int, run int, edge boolean, keep_k long, keep_n long, size long, first boolean, text binary"


def _normalise(batches):
    for b in C.slices(batches):
        norm = [t.translate(None, b" \t\n\x0b\x0c\r") for t in C.text_bytes(b.column("_x"))]
        yield pa.RecordBatch.from_arrays(
            [b.column("_k"), b.column("_n"), pa.array([x[:48] for x in norm], pa.binary()), pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary()), pa.array(norm, pa.binary())],
            names=["_k", "_n", "head", "sha", "norm"],
        )


def _runs(batches):
    """Rows come sorted by text, then rank: a run's first row is the one to keep.
    A run's rows are let go when it ends; rows of the first and last are marked."""
    part, no, last, rows, size = TaskContext.get().partitionId(), 0, None, [], 0
    names = ["_k", "_n", "sha", "part", "run", "edge", "keep_k", "keep_n", "size", "first", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    out: list[tuple] = []

    def close(edge: bool):
        k0, n0, sha = rows[0][0], rows[0][1], rows[0][2].hex()
        out.extend((k, n, sha, part, no, edge, k0, n0, len(rows), i == 0, last if edge and i == 0 else None) for i, (k, n, _) in enumerate(rows))

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        out.clear()
        return made

    for b in C.slices(batches):
        ks, ns, shas, norms = (b.column(c).to_pylist() for c in ("_k", "_n", "sha", "norm"))
        for k, n, sha, norm in zip(ks, ns, shas, norms, strict=True):
            if last is not None and norm != last:
                close(no == 0)
                no, rows = no + 1, []
                if len(out) >= 10_000:
                    yield batch()
            last = norm
            rows.append((k, n, sha))
    if rows:
        close(True)
    if out:
        yield batch()


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    C.ship(spark)
    x = docs.select(C.key(id_col).alias("_k"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("_n"), F.col(text_col).alias("_x"))
    x = x.mapInArrow(_normalise, "_k long, _n long, head binary, sha binary, norm binary")
    keys = ["head", "sha", F.col("_n").desc(), "_k"]
    x = x.repartitionByRange(C.n_parts(spark), *keys).sortWithinPartitions("head", "sha", "norm", F.col("_n").desc(), "_k")
    runs = C.stash(x.select("_k", "_n", "sha", "norm").mapInArrow(_runs, _OUT), "exact")
    # Two runs a partition at most; those of one text, as three numbers each.
    run = F.struct((-F.col("keep_n")).alias("n"), F.col("keep_k").alias("k"), "part", "run", "size")
    groups = runs.where("edge AND first").groupBy("text").agg(F.array_sort(F.collect_list(run)).alias("runs")).where(F.size("runs") > 1).select("runs").collect()
    whole = [(r.part, r.run, g.runs[0].n, g.runs[0].k, g.runs[0].part, sum(x.size for x in g.runs)) for g in groups for r in g.runs]
    joined = spark.createDataFrame(whole, "part int, run int, w_n long, w_k long, w_part int, w_size long")
    runs = runs.drop("text").join(F.broadcast(joined), ["part", "run"], "left")
    first = F.col("first") & (F.col("w_part").isNull() | (F.col("part") == F.col("w_part")))
    return runs.select(C.id_of("_k").alias(id_col), F.when(F.coalesce("w_k", "keep_k") != C.NO_ID, F.coalesce("w_k", "keep_k")).alias("keep_id"), F.coalesce("w_size", "size").alias("group_size"), first.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_sql(table: str = "documents") -> str:
    return f"""
WITH a AS (SELECT doc_id, length(coalesce(text, '')) AS n,
  translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM {table}),
b AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM a)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM b"""
