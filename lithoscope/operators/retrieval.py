"""Chunks of source text, their vectors, and the nearest of them to a question."""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.udf import pandas_function
from .parsing import Code


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed to signed places: deterministic, without a model or a network."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dims] += 1 if h >> 63 else -1
            n = math.sqrt(float((out[i] ** 2).sum()))
            if n:
                out[i] /= n
        return out


def _cut(text: Column) -> Column:
    return F.when(F.length(text) > V.CHUNK_CHARS, F.concat(F.left(text, F.lit(V.CHUNK_CHARS)), F.lit("\n... (truncated)"))).otherwise(text)


def symbol_chunks(bodies: DataFrame) -> DataFrame:
    """One chunk a symbol; a class and its methods overlap."""
    x = bodies.withColumn("t", F.array_join("body", "\n")).where(T.strip(F.col("t")) != "")
    return x.select("job_id", "file_seq", F.col("path").alias("file"), F.col("sym_seq").alias("seq"), _cut(F.col("t")).alias("text"), "start_line", "end_line", F.col("name").alias("symbol"))


def window_chunks(sources: DataFrame, size: int = V.WINDOW_LINES, overlap: int = V.OVERLAP_LINES) -> DataFrame:
    """Windows of lines that overlap; the last is the one that reaches the end."""
    step = size - overlap
    x = sources.select("job_id", "file_seq", "path", T.lines("source").alias("l")).withColumn("n", F.size("l")).where("n > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    x = x.select("*", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    t = F.array_join(F.slice("l", F.col("i") * step + 1, size), "\n")
    x = x.withColumn("t", t).where(T.strip(F.col("t")) != "")
    return x.select("job_id", "file_seq", F.col("path").alias("file"), F.col("i").alias("seq"), _cut(F.col("t")).alias("text"), (F.col("i") * step + 1).alias("start_line"), F.least(F.col("i") * step + size, F.col("n")).alias("end_line"), F.lit(None).cast("string").alias("symbol"))


def chunk_repository(code: Code) -> DataFrame:
    """Chunks by symbol where a file has symbols, else by window."""
    plain = Code(code.parsed.where(F.size("symbols") == 0))
    return symbol_chunks(code.bodies).unionByName(window_chunks(plain.sources))


def index(chunks: DataFrame, embedder: Embedder | None = None, most: int = V.MAX_CHUNKS) -> DataFrame:
    """The first chunks of each job with chunk_id and embedding."""
    e = embedder or HashingEmbedder()
    x = chunks.withColumn("n", F.row_number().over(W.partitionBy("job_id").orderBy("file_seq", "file", "seq"))).where(F.col("n") <= most)

    @pandas_function("array<float>")
    def embedded(text: pd.Series) -> pd.Series:
        return pd.Series(list(e.embed(text.tolist())))

    return x.select(F.concat("job_id", F.lit("::"), (F.col("n") - 1).cast("string")).alias("chunk_id"), "job_id", "text", "file", "start_line", "end_line", "symbol", embedded("text").alias("embedding"))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def nearest(vectors: DataFrame, query: list[float], top_k: int = V.TOP_K, embedding: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """The top_k rows nearest to a vector; each task keeps top_k, and so does the end."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", squared_distance(embedding, q)).orderBy("distance", tie).limit(top_k)


def source_chunks(vectors: DataFrame, file: str) -> DataFrame:
    return vectors.where(F.col("file") == file).orderBy(F.coalesce("start_line", F.lit(0)), "chunk_id")


def viewed(chunks: DataFrame) -> DataFrame:
    """A file's stored chunks as one text with a header for each range of lines."""
    x = chunks.groupBy("job_id", "file").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("s"), "end_line", "text"))).alias("c"))
    return x.select("job_id", "file", F.array_join(F.transform("c", lambda c: F.concat(F.lit("// lines "), c["s"].cast("string"), F.lit("-"), c["end_line"].cast("string"), F.lit("\n"), c["text"])), "\n\n").alias("text"))


def fallback_answer(hits: list, most: int = 3, chars: int = 500) -> str:
    """What is shown where no language model is configured."""
    if not hits:
        return "No language model is configured and no relevant code was found for this question."
    parts = [f"**{h['file']}:{h['start_line']}-{h['end_line']}**\n```\n{h['text'][:chars]}\n```" for h in hits[:most]]
    return "\n\n".join(["No language model is configured: the most relevant code found is shown instead.", *parts])
