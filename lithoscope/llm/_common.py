"""Helpers shared by the corpus operators: shipping the package, work tables,
row keys and vectorised word hashing."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, `[\x20\x09-\x0D]`: also what bytes.split() splits at.
SPACE = " \t\n\x0b\x0c\r"
#: A missing document id sorts after every other id.
NO_ID = (1 << 63) - 1

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    workers import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(root)
    folder = tempfile.mkdtemp(prefix="ship")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it while the driver lives
    path = os.path.join(folder, f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), top))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, on one
    machine a temporary one, and on a cluster an error: executors would not see it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="work")
        spark.conf.set("spark.checkpoint.dir", d)
    return f"{d.rstrip('/')}/{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a work table to the shared folder and read it again.
    A lost executor then costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key(id_col: str) -> Column:
    """A document's id as a number that is never null; see NO_ID."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def id_of(k: str) -> Column:
    return F.when(F.col(k) != NO_ID, F.col(k))


def text_bytes(a: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 without a detour through str; null counts as empty."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if isinstance(a, pa.ChunkedArray):  # several chunks may remain
        return [x for c in a.chunks for x in text_bytes(c)]
    kind = pa.large_binary() if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else pa.binary()
    return [x or b"" for x in a.cast(kind).to_pylist()]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_T = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_pows: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pows[0]) < n:
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _pows[i] = np.multiply.accumulate(p)
    return _pows[0], _pows[1]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, concatenated.

    text: the words joined by one space; start, end: byte offsets of each word;
    doc: index of the text it is in; hash: 64 bits that depend on its bytes only."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        split = [t.split() for t in texts]  # bytes.split() knows exactly the six characters
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        text = b" ".join(b" ".join(s) for s in split if s)
        if lower:
            text = text.lower()  # of bytes: A-Z only
        self.text, n = text, int(self.counts.sum())
        self.doc = np.repeat(np.arange(len(split)), self.counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        b = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero(b == 32)
        self.start = np.concatenate(([0], gaps + 1))
        self.end = np.concatenate((gaps, [len(b)]))
        up, down = _powers(len(b))
        s = np.empty(len(b) + 1, np.uint64)
        s[0] = 0
        np.cumsum(_T[b] * up[: len(b)], out=s[1:])
        self.hash = mix((s[self.end] - s[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k numbers in a row."""
    r = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        r = r * np.uint64(_BASE) + h[i : i + len(r)]
    return mix(r)


def without_gc(f):
    """f with the collector of reference cycles off: f makes none, and looking for them
    among millions of small objects takes a quarter of its time."""

    def run(*args):
        gc.disable()
        try:
            return f(*args)
        finally:
            gc.enable()

    return run


def slices(batches, rows: int = 1000):
    """Arrow batches cut into small ones, so that what is made of a batch in Python stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def blocks(texts: list[bytes], most: int = 1 << 18):
    """Index ranges of texts with about `most` bytes each, to bound memory."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def counted_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, most_hot: int = 1000) -> DataFrame:
    """left outer join with a table of unique keys whose `weight` says how many
    rows of left (which sum to `total`) hold each key.

    At most `most_hot` keys can hold more than 1/most_hot of all rows: only those
    are broadcast.  Rows that matched one go on with a salt that matches nothing,
    so that no task receives a hot key; the others take an ordinary join."""
    cols = [c for c in right.columns if c not in on]
    hot = right.where(F.col(weight) * most_hot > total)
    a = hot.select(*on, *[F.col(c).alias(f"_hot_{c}") for c in cols], F.lit(True).alias("_is_hot"))
    b = right.where(F.col(weight) * most_hot <= total).withColumn("_salt", F.lit(0).cast("long"))
    x = left.join(F.broadcast(a), on, "left")
    x = x.withColumn("_salt", F.when(F.col("_is_hot"), F.xxhash64(*[F.col(c) for c in left.columns]).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")))
    x = x.join(b, [*on, "_salt"], "left")
    return x.select(*left.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in cols])
