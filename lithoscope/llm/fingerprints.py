"""Document fingerprints: a threshold-scaled sketch, in Spark's functions only.

A sketch holds the hash of every five-word shingle that falls below a fixed
fraction of the hash range (`limit_of`).  Sketches of the same fraction merge by union, and the
share of the smaller that is in the larger estimates containment however unequal
the documents are: an excerpt's hashes below the limit are all among those of the whole.

A fingerprint is the sketch and, so that texts without a hash below the limit can be
told apart, the smallest hash of a text that has none.  That extra hash lies above the
limit and takes no part in any estimate.  Where a side has no hash below the limit
there is nothing to estimate from: the likeness is 1.0 for equal fingerprints (equal
sets, as a rule), else 0.0.

Defined cases: a null or empty text, or one without a word, has the empty
fingerprint; with fewer than five words the whole sequence is the one shingle; equal
ids are ordered by the hash of their texts, a null id comes last; an id that is no number is
refused by the cast to long; a very long text is one row, held as arrays of its words and
shingles by one task; other columns are ignored, whatever their names; repeated rows
repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

WORDS = 5
FRACTION = 1 / 4
#: Edges between ranges of ids, found in two steps of so many.
_STEP = 32


def limit_of(fraction: float) -> Column:
    """Hashes below it are kept."""
    return F.lit(-(1 << 63) + int(fraction * (1 << 64)) if fraction < 1 else (1 << 63) - 1)


def add_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION, k: int = WORDS) -> DataFrame:
    """df with `out`, an ascending array of hashes.  In steps of their own, so that
    no array is computed twice."""
    w, s = f"_{out}_w", f"_{out}_s"
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)]))
    df = df.withColumn(s, F.when(F.size(w) >= k, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    low = F.filter(s, lambda h: h < limit_of(fraction))
    low = F.when((F.size(low) > 0) | (F.size(s) == 0), low).otherwise(F.array(F.array_min(s)))
    return df.withColumn(out, F.sort_array(F.array_distinct(low))).drop(w, s)


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The fingerprint of two documents' union."""
    u = F.array_union(a, b)
    low = F.filter(u, lambda h: h < limit_of(fraction))
    return F.sort_array(F.when((F.size(low) > 0) | (F.size(u) == 0), low).otherwise(F.array(F.array_min(u))))


def _likeness(a: str, b: str, fraction: float, share) -> Column:
    """share(common, of a, of b), from counts of hashes below the limit on both sides."""
    n = lambda c: F.when(F.get(F.col(c), F.lit(0)) < limit_of(fraction), F.size(c)).otherwise(0)  # noqa: E731  (ascending: all or none)
    return F.when(F.least(n(a), n(b)) > 0, share(F.size(F.array_intersect(a, b)), n(a), n(b))).otherwise((F.col(a) == F.col(b)).cast("int")).cast("double")


def containment(a: str, b: str, fraction: float = FRACTION) -> Column:
    """The estimated share of the smaller document's shingles in the larger's."""
    return _likeness(a, b, fraction, lambda both, n, m: both / F.least(n, m))


def jaccard(a: str, b: str, fraction: float = FRACTION) -> Column:
    return _likeness(a, b, fraction, lambda both, n, m: both / (n + m - both))


def as_text(a: str) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), ",")


def _bucket(x: DataFrame, key: str, tie: str, rows: int) -> Column | None:
    """Buckets of about `rows` rows whose order is the order of (key, tie), whatever the
    keys look like.  Quantiles of the key cut it into a thousand ranges, each cut
    into equal steps; a key that is several quantiles at once has a range of its own,
    cut into equal steps of the tie, which is a hash.  None for an empty table."""
    many = _STEP * _STEP
    s = x.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.percentile_approx(key, [i / many for i in range(1, many)], 20 * many).alias("q")).first()
    if not s["n"]:
        return None
    points = [s["lo"], *s["q"]]
    edges = sorted(set(points))
    times = [points.count(e) for e in edges]  # of a key with more than a thousandth of all rows
    steps = max(1, s["n"] // (many * rows))
    width = steps * max(times)
    parts = [edges[i : i + _STEP] for i in range(0, len(edges), _STEP)]
    array = lambda xs, kind="array<bigint>": F.from_json(F.lit(str(xs)), kind)  # noqa: E731  (one constant, not a thousand)
    upto = lambda es: F.size(F.filter(es, lambda e: e <= F.col(key)))
    i = upto(array([p[0] for p in parts])) - 1
    j = i * _STEP + upto(F.get(array(parts, "array<array<bigint>>"), i)) - 1
    at = lambda xs: F.get(array(xs), j)
    low, high = at(edges).cast("double"), at([*edges[1:], s["hi"]]).cast("double")
    by_key = F.least(F.lit(steps - 1), F.floor((F.col(key) - low) * steps / F.greatest(high - low, F.lit(1.0))))
    by_tie = F.floor((F.col(tie) / float(1 << 64) + 0.5) * F.when(at(times) > 1, at(times) * steps).otherwise(1))
    bucket = F.when(F.col(key) == at(edges), 2 * j * width + F.least(by_tie, F.lit(width - 1))).otherwise((2 * j + 1) * width + by_key).cast("long")
    return F.coalesce(bucket, F.lit(0).cast("long"))  # never null, and known not to be: no filter sets the branches of with_next apart


def with_next(x: DataFrame, key: str, tie: str, carry: list[str], rows: int = 400) -> DataFrame:
    """x with next_<c> of the row that follows by (key, tie); the first follows the last.

    A window within each bucket finds most followers; a bucket's last row gets the first
    row of the next bucket that has any."""
    bucket = _bucket(x.select(key), key, tie, rows)
    if bucket is None:
        return x.select("*", *[F.lit(None).cast(x.schema[c].dataType).alias(f"next_{c}") for c in carry])
    x = x.withColumn("_b", bucket)
    heads = x.groupBy("_b").agg(F.count("*").alias("_c")).drop("_c")
    inner = Window.partitionBy(F.floor(F.col("_b") / 1024)).orderBy("_b")
    chain = heads.withColumn("_nb", F.lead("_b").over(inner))
    # Of each 1,024 buckets one row is left to link.
    tops = heads.groupBy(F.floor(F.col("_b") / 1024).alias("_s")).agg(F.min("_b").alias("_f"))
    tops = tops.withColumn("_nf", F.coalesce(F.lead("_f").over(Window.orderBy("_s")), F.first("_f").over(Window.orderBy("_s"))))
    chain = chain.join(tops.select("_s", "_nf"), F.floor(F.col("_b") / 1024) == F.col("_s"), "left").select("_b", F.coalesce("_nb", "_nf").alias("_nb"))
    dealt = x.repartition("_b")
    w = Window.partitionBy("_b").orderBy(key, tie)
    row = F.struct(*carry)
    keep = [c for c in x.columns if c != "_b"]
    # All but the last row of each bucket: nothing more is shuffled.
    most = dealt.withColumn("_next", F.lead(row).over(w)).where("_next IS NOT NULL")
    # One row a bucket, from either end, meets over the chain of buckets.
    back = Window.partitionBy("_b").orderBy(F.desc(key), F.desc(tie))
    tails = dealt.withColumn("_r", F.row_number().over(back)).where("_r = 1")
    first = dealt.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("_b").alias("_nb"), row.alias("_next"))
    ends = tails.join(chain, "_b").join(first, "_nb")
    out = most.select(*keep, "_next").unionByName(ends.select(*keep, "_next"))
    return out.select(*keep, *[F.col("_next")[c].alias(f"next_{c}") for c in carry])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """One row per row of docs: id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (containments), jaccard_edited,
    jaccard_next."""
    x = docs.select(C.key(id_col).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_x"))
    # A row's own sketch goes with its text to the row before.
    x = add_sketch(x.withColumn("_h", F.xxhash64("_x")), "_x", "a", fraction)
    y = with_next(x, "_k", "_h", ["_x", "a"]).withColumn("_n", F.length("_x"))
    half = F.floor(F.col("_n") / 2).cast("int")
    y = y.withColumn("_e", F.concat(F.substring("_x", F.lit(1), F.col("_n") - half), F.substring("next__x", F.lit(1), half)))
    y = add_sketch(y, "_e", "b", fraction)
    return y.select(
        C.id_of("_k").alias(id_col), F.col("_n").cast("long").alias("n_chars"), F.sha2(F.col("_e"), 256).alias("edited_sha256"), as_text("a").alias("fingerprint"), as_text("b").alias("edited_fingerprint"),
        containment("a", "b", fraction).alias("near_edited"), containment("a", "next_a", fraction).alias("near_next"), jaccard("a", "b", fraction).alias("jaccard_edited"), jaccard("a", "next_a", fraction).alias("jaccard_next"),
    )
