"""Line dedup, in Spark's own functions throughout.

Explode the lines' normalised keys, hash them, count the distinct documents of
each hash, and drop a line everywhere but in the smallest document that holds it
once its hash is in `least_docs` documents or more.  Texts are put together again
by position.  A hash is 128 bits in two longs.  The count combines before it
shuffles; hashes that hold over a thousandth of all lines are sent to every task
(a thousand at most) and their lines are not shuffled by hash.

Defined cases: a null or empty text is one empty line; a null id is one document
after all others; rows that repeat an id are one document when counting and each
loses the same lines; an id that is no number is refused by the cast to long; a very
long text is one row, with an array of its lines, in one task; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped, and A-Z lower-cased: where all is ASCII lower() does just that, without
    the look-up of every character."""
    k = F.btrim(line, F.lit(C.SPACE))
    return F.when(F.octet_length(k) == F.length(k), F.lower(k)).otherwise(F.translate(k, _UP, _LOW))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """One row per row of docs: id_col, n_lines, n_dropped, text_col (what is left)."""
    x = docs.select(C.key(id_col).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_x"))
    lines = F.split("_x", "\n", -1)
    keyed = x.select("_k", F.xxhash64("_x").alias("_t"), F.posexplode(lines).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_chars)
    keyed = C.stash(keyed.select("_k", "_t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "keys")  # lines are cut and keyed once
    if least_docs == 2:  # two distinct documents: the smallest is not the largest
        hashes = keyed.groupBy("h1", "h2").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    else:
        per_doc = keyed.groupBy("h1", "h2", "_k").agg(F.count("*").alias("n"))
        hashes = per_doc.groupBy("h1", "h2").agg(F.min("_k").alias("lo"), F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs)
    hashes = C.stash(hashes.select("h1", "h2", "lo", "n"), "lines")
    total = hashes.agg(F.sum("n")).first()[0] or 0
    drop = C.counted_join(keyed, hashes, ["h1", "h2"], "n", total).where("_k > lo")
    drop = drop.groupBy("_k", "_t").agg(F.collect_set("pos").alias("gone"))
    y = x.withColumn("_t", F.xxhash64("_x")).join(drop, ["_k", "_t"], "left")
    n, gone = F.size(lines), F.coalesce(F.size("gone"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("_x")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    y = y.withColumn("lines", lines)
    return y.select(C.id_of("_k").alias(id_col), n.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"), kept.alias(text_col))


def lines_sql(table: str = "documents") -> str:
    six = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}),
b AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM a),
c AS (SELECT doc_id, pos, line, translate(trim(line, {six}), '{_UP}', '{_LOW}') AS key FROM b),
d AS (SELECT key, min(doc_id) AS lo FROM c WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
e AS (SELECT c.*, d.lo IS NOT NULL AND c.doc_id > d.lo AS gone FROM c LEFT JOIN d USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM e GROUP BY doc_id"""
