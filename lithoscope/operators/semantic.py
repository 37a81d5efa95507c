"""Vectors with meaning: latent semantic analysis of chunks, as aggregates.

Identifiers are split into words.  A chunk's row has a weight for each of its words,
(1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), scaled to length one.  The space that holds most
of these rows is found by a randomised range finder: each word starts with numbers made
from its hash, rows gather the numbers of their words and words those of their rows, by
joins and sums, and the words' numbers are made orthonormal again by their Gram matrix, a
few numbers on the driver.  What comes out is a table of words with vectors; a text's
vector is the weighted sum of those of its words, scaled to length one.  Words that occur
together come to point the same way, so that a question finds chunks that share none of
its words.

Texts are read and counted once, into blocks of chunks, each a row with words and counts
of its own.  Words are dealt to parts, each a row with the vectors of its words.  What
moves between the two is a message for each block and part, with a vector for each word
that the block has of the part: neither a count nor a vector moves for each word of each
chunk.  A block has about `block_rows` counts, whatever the corpus, and a part is asked for
about `part_rows` vectors.

The model is a table and grows with the vocabulary; nothing but the Gram matrix, of
`dims` squared numbers, comes to the driver.  Words in a single chunk tell nothing about
others and are left out, as are words in more than `most_share` of all chunks, whose
rows would meet in one place and which weigh least.

Defined cases: a chunk without known words has no vector (null); null texts have no words;
rows that repeat an id are one chunk with the words of all; a corpus with less rank than
`dims` has zeros in the places left over; an empty table gives an empty model."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import ship
from ..sources.store import shared_folder


#: Places where a word in camel case ends. The letter behind \p{N} is of \p{Ll} itself, and
#: makes Java look back by code points.
_SEAM = r"(?=\p{Lu})(?:(?<=[\p{Ll}\p{N}𐐨])|(?<=[\p{Lu}𐐀])(?=\p{Lu}\p{Ll}))"


def _lowered(text: Column | str) -> Column:
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.lower(F.regexp_replace(t, _SEAM, " "))


def words(text: Column | str) -> Column:
    """The words of a text, with identifiers in camel case or with underscores taken apart."""
    return F.regexp_extract_all(_lowered(text), F.lit(r"[a-z0-9\p{L}\p{N}]+"), F.lit(0))


def counts(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """id, word, tf"""
    return chunks.select(F.col(id_col).alias("id"), F.explode(words(text_col)).alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))


def vocabulary(counted: DataFrame, most_share: float = 0.5) -> DataFrame:
    """word, idf of the words that tell chunks apart."""
    n = counted.agg(F.count_distinct("id").alias("n")).first()["n"]
    df = counted.groupBy("word").agg(F.count("*").alias("df")).where((F.col("df") > 1) & (F.col("df") <= max(2.0, most_share * n)))
    return df.select("word", (F.log((F.lit(1.0) + n) / (1.0 + F.col("df"))) + 1).alias("idf"))


def weights(counted: DataFrame, known: DataFrame, name: str = "word") -> DataFrame:
    """id, word, a: each chunk's row, of length one; `name` is the column of known that
    stands for the word."""
    x = counted.join(known.select("word", "idf", F.col(name).alias("_name")), "word").select("id", F.col("_name").alias("word"), ((F.log("tf") + 1) * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return x.select("id", "word", (F.col("w") / length).alias("a"))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Written and read again, so that several readers compute it once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # rows can be large: sizes are looked at after each
    df.write.options(**{"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(ids: pa.Array) -> np.ndarray:
    """Which ids, but the first, are those before them."""
    a, b = ids.slice(1), ids.slice(0, max(0, len(ids) - 1))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _counted(texts: pa.Array, chunk: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and chunk, word and count of all that there are."""
    cut = pc.split_pattern(texts, " ")
    chunk, word = np.repeat(chunk, pc.list_value_length(cut).to_numpy()), cut.flatten()
    real = pc.greater(pc.binary_length(word), 0)
    coded = word.filter(real).dictionary_encode()
    n = max(1, len(coded.dictionary))
    pair, tf = np.unique(chunk[real.to_numpy(zero_copy_only=False)] * n + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, pair // n, pair % n, tf


def _merged(pieces: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces under one numbering of their words, in the order of the words."""
    coded = pa.concat_arrays([x[0] for x in pieces]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    new, at, word = place[coded.indices.to_numpy()], 0, []
    for x in pieces:
        word.append(new[at + x[2]])
        at += len(x[0])
    n = max(1, len(order))
    pair = np.concatenate([x[1] for x in pieces]) * n + np.concatenate(word).astype(np.int64)
    by = np.argsort(pair, kind="stable")
    pair, tf = pair[by], np.concatenate([x[3] for x in pieces])[by]
    first = np.flatnonzero(np.diff(pair, prepend=-1))  # a chunk of several rows can have a word in two pieces
    pair, tf = pair[first], np.add.reduceat(tf, first) if len(first) else tf
    return coded.dictionary.take(pa.array(order)), pair // n, pair % n, tf


def _block(ids: list[pa.Array], pieces: list[tuple]) -> pa.RecordBatch:
    """One row."""
    words, chunk, word, tf = _merged(pieces)
    ids, word = pa.concat_arrays(ids), word.astype(np.int32)
    has = np.bincount(chunk, minlength=len(ids))
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    packed = [pa.array([x.tobytes()], pa.binary()) for x in (np.cumsum(has), word, tf.astype(np.int32))]
    df = pa.array(np.bincount(word, minlength=len(words)).astype(np.int32))
    return pa.RecordBatch.from_arrays([one(ids), *packed, one(words), one(df), pa.array([np.count_nonzero(has)], pa.int64())], names=["ids", "ends", "word", "tf", "words", "df", "full"])


def blocks(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", block_rows: int = 3_000_000) -> DataFrame:
    """block, ids, ends, word, tf, words, df, full: a row for some chunks.  Of each chunk the
    places of its words in `words` and their counts, up to its end; of each word in how many
    of the chunks it is; how many of the chunks have words."""
    spark = chunks.sparkSession
    ship(spark)

    def run(batches):
        ids, pieces, last, held, n, most = [], [], None, 0, 0, block_rows
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            key = b.column("id")
            again = last is not None and bool(_same(pa.concat_arrays([last, key.slice(0, 1)]))[0])
            if held >= block_rows and not again:
                yield _block(ids, pieces)
                ids, pieces, held, n, most = [], [], 0, 0, block_rows
            elif held >= most:  # a chunk of many rows
                pieces = [_merged(pieces)]
                held = len(pieces[0][3])
                most = max(block_rows, 2 * held)
            new = np.concatenate([[not again], ~_same(key)])
            pieces.append(_counted(b.column("text"), n - 1 + np.cumsum(new)))
            ids.append(key.filter(pa.array(new)))
            held, n, last = held + len(pieces[-1][3]), n + len(ids[-1]), key.slice(len(key) - 1)
        if ids:
            yield _block(ids, pieces)

    x = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(2 * spark.sparkContext.defaultParallelism, "id").sortWithinPartitions("id")
    x = x.select("id", F.regexp_replace(_lowered("text"), r"[^a-z0-9\p{L}\p{N}]+", " ").alias("text"))
    made = x.mapInArrow(run, f"ids array<{x.schema['id'].dataType.simpleString()}>, ends binary, word binary, tf binary, words array<string>, df array<int>, full long")
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


def _placed(cut: DataFrame, most_share: float, part_rows: int) -> DataFrame:
    """word, idf, part, pos of the words that tell chunks apart."""
    n, asked = cut.agg(F.sum("full"), F.sum(F.size("words"))).first()
    df = cut.select(F.inline(F.arrays_zip("words", "df"))).groupBy(F.col("words").alias("word")).agg(F.sum("df").alias("df")).where((F.col("df") > 1) & (F.col("df") <= max(2.0, most_share * (n or 0))))
    part = F.pmod(F.xxhash64("word"), F.lit(max(1, -(-(asked or 0) // part_rows)))).cast("int")
    pos = F.row_number().over(Window.partitionBy("part").orderBy("word")) - 1
    return df.select("word", (F.log((F.lit(1.0) + (n or 0)) / (1.0 + F.col("df"))) + 1).alias("idf"), part.alias("part")).withColumn("pos", pos)


def _own_words(cut: DataFrame) -> DataFrame:
    """block, at, word: the words of each block."""
    return cut.select(F.col("block").alias("block"), F.posexplode("words").alias("at", "word"))


def _numbers(column, kind) -> np.ndarray:
    """A column of packed numbers as one array."""
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in column]])


def _ends(column) -> np.ndarray:
    """Where each value of packed places ends."""
    return np.cumsum([len(x.as_buffer()) // 4 for x in column])


def _packed(x: np.ndarray, ends) -> pa.Array:
    """Rows of x up to each end, a value each, without a copy."""
    at = np.concatenate([[0], ends]) * (x.itemsize * (x.shape[1] if x.ndim > 1 else 1))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _asked(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """part, block, pos, at, idf: what each block asks each part for."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        by = np.argsort(t.column("block").to_numpy(), kind="stable")
        block, n = np.unique(t.column("block").to_numpy()[by], return_counts=True)
        cols = [_packed(t.column(c).to_numpy()[by], np.cumsum(n)) for c in ("pos", "at", "idf")]
        return pa.table([pa.array(np.full(len(block), key[0].as_py()), pa.int32()), pa.array(block), *cols], ["part", "block", "pos", "at", "idf"])

    x = _own_words(cut).join(placed, "word").select("part", "block", "pos", "at", "idf")
    return x.groupBy("part").applyInArrow(run, "part int, block long, pos binary, at binary, idf binary")


def _started(placed: DataFrame, dims: int) -> DataFrame:
    """part, v: numbers of all words of a part, made from their hashes."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([x[np.argsort(t.column("pos").to_numpy())].tobytes()], pa.binary())})

    start = F.array(*[(F.xxhash64("word", F.lit(j)) / F.lit(float(1 << 63))) for j in range(dims)])
    return placed.select("part", "pos", start.alias("v")).groupBy("part").applyInArrow(run, "part int, v binary")


def _sent(asked: DataFrame, vectors: DataFrame, turn: np.ndarray) -> DataFrame:
    """block, part, pos, at, idf, v: the vectors that blocks ask for, times a matrix."""

    def run(_, asked: pa.Table, vectors: pa.Table) -> pa.Table:
        x = (_numbers(vectors.column("v"), np.float64).reshape(-1, len(turn)) @ turn).astype(np.float32)
        v = _packed(x[_numbers(asked.column("pos"), np.int32)], _ends(asked.column("pos")))
        return asked.select(["block", "part", "pos", "at", "idf"]).append_column("v", v)

    return asked.groupBy("part").cogroup(vectors.groupBy("part")).applyInArrow(run, "block long, part int, pos binary, at binary, idf binary, v binary")


class _Rows:
    """The rows of a block and the vectors of its known words, in order of idf so that those of
    common words lie together; the vector of all other words is zero and the last."""

    def __init__(self, block: pa.Table, at: np.ndarray, idf: np.ndarray, v: np.ndarray):
        self.ends, word, tf = (_numbers(block.column(c), k) for c, k in (("ends", np.int64), ("word", np.int32), ("tf", np.int32)))
        self.order = np.argsort(idf, kind="stable")
        self.idf, self.v = np.append(idf[self.order], 0.0), np.zeros((len(at) + 1, v.shape[1]), np.float32)
        np.take(v, self.order, 0, out=self.v[:-1])
        place = np.full(int(block.column("n").to_numpy().sum()), len(at), np.int32)
        place[at[self.order]] = np.arange(len(at), dtype=np.int32)
        self.word, self.weight = place[word], np.log(tf) + 1

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's row times the vectors, and the square of its length."""
        out, length, a = np.zeros((len(self.ends), self.v.shape[1])), np.zeros(len(self.ends)), 0
        for i, b in enumerate(self.ends.tolist()):
            if b > a:
                word = self.word[a:b]
                row = self.weight[a:b] * self.idf.take(word)
                out[i], length[i] = row @ self.v.take(word, 0), row @ row
            a = b
        return out, length

    def back(self, y: np.ndarray) -> np.ndarray:
        """Each known word's column times a vector for each chunk, in the order that the words
        came in.  Words in as many chunks are taken together."""
        low = np.argsort(self.word.astype(np.uint16), kind="stable").astype(np.int32)  # of 16 bits, numpy sorts by radix
        by = low[np.argsort((self.word >> 16).astype(np.uint16)[low], kind="stable")]
        n = np.bincount(self.word, minlength=len(self.idf))[:-1]
        doc, w = np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(self.ends, prepend=0))[by], self.weight[by]
        first, out, alike = np.cumsum(n) - n, np.zeros((len(n), y.shape[1]), np.float32), np.argsort(n, kind="stable")
        for words in np.split(alike, np.flatnonzero(np.diff(n[alike])) + 1) if n.any() else []:
            m = n[words[0]]
            step = max(1, 10_000 // max(1, m))
            for some in (words[i : i + step] for i in range(0, len(words), step)):
                at = first[some, None] + np.arange(m)
                out[self.order[some]] = np.matmul(w[at][:, None], y.take(doc[at], 0))[:, 0] * self.idf[some, None]
        return out


def _round(cut: DataFrame, sent: DataFrame, dims: int) -> DataFrame:
    """part, v: the words' vectors times the rows' matrix and its transpose."""

    def run(_, block: pa.Table, sent: pa.Table) -> pa.Table:
        pos, part = sent.column("pos"), sent.column("part")
        if not (block.num_rows and sent.num_rows):
            return pa.table({"part": part, "pos": pos, "v": pos}).slice(0, 0)
        rows = _Rows(block, *(_numbers(sent.column(c), k) for c, k in (("at", np.int32), ("idf", np.float64))), _numbers(sent.column("v"), np.float32).reshape(-1, dims))
        y, length = rows.sums()
        return pa.table({"part": part, "pos": pos, "v": _packed(rows.back(y / np.where(length > 0, length, 1)[:, None]), _ends(pos))})

    def summed(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        pos = [np.frombuffer(x.as_buffer(), np.int32) for x in t.column("pos")]
        out = np.zeros((max(int(x.max()) for x in pos) + 1, dims))
        for p, v in zip(pos, t.column("v"), strict=True):
            out[p] += np.frombuffer(v.as_buffer(), np.float32).reshape(-1, dims)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([out.tobytes()], pa.binary())})

    rows = cut.select("block", "ends", "word", "tf", F.size("words").alias("n"))
    parts = rows.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, "part int, pos binary, v binary")
    return parts.groupBy("part").applyInArrow(summed, "part int, v binary")


def _gram(vectors: DataFrame, dims: int) -> np.ndarray:
    """Sum of the outer products of all vectors with themselves."""

    def run(batches):
        g = np.zeros((dims, dims))
        for b in batches:
            for part in b.column("v"):
                x = np.frombuffer(part.as_buffer(), np.float64).reshape(-1, dims)
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims * dims), pa.int32()), pa.array(g.reshape(-1))], names=["at", "g"])

    out = np.zeros(dims * dims)
    for r in vectors.select("v").mapInArrow(run, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).collect():
        out[r["at"]] = r["g"]
    return out.reshape(dims, dims)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()), pa.array(x.reshape(-1)))


def _model(placed: DataFrame, vectors: DataFrame, turn: np.ndarray) -> DataFrame:
    """word, idf, v"""

    def run(_, words: pa.Table, vectors: pa.Table) -> pa.Table:
        x = (_numbers(vectors.column("v"), np.float64).reshape(-1, len(turn)) @ turn)[words.column("pos").to_numpy()]
        return pa.table({"word": words.column("word"), "idf": words.column("idf"), "v": _lists(x)})

    return placed.groupBy("part").cogroup(vectors.groupBy("part")).applyInArrow(run, "word string, idf double, v array<double>")


def _embedded(cut: DataFrame, sent: DataFrame, dims: int, id_col: str) -> DataFrame:
    """id_col, embedding of each chunk of the blocks; sent: block, and at, idf, v, as numbers or packed."""
    packed = dict(sent.dtypes)["at"] == "binary"

    def run(_, block: pa.Table, sent: pa.Table) -> pa.Table:
        ids = block.column("ids").combine_chunks().flatten()
        if packed:
            at, own, v = (_numbers(sent.column(c), k) for c, k in (("at", np.int32), ("idf", np.float64), ("v", np.float32)))
        else:
            at, own, v = sent.column("at").to_numpy(), sent.column("idf").to_numpy(), sent.column("v").combine_chunks().flatten().to_numpy()
        y, _ = _Rows(block, at, own, v.astype(np.float32).reshape(-1, dims)).sums()
        length = np.sqrt((y * y).sum(1))
        real, out = length > 0, y / np.where(length > 0, length, 1)[:, None]
        lists = _lists(out.astype(np.float32))
        return pa.table({"id": ids, "embedding": lists.take(pa.array(np.arange(len(ids)), mask=~real))})

    rows = cut.select("block", "ids", "ends", "word", "tf", F.size("words").alias("n"))
    kind = cut.schema["ids"].dataType.elementType.simpleString()
    return rows.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def fit_embed(chunks: DataFrame, dims: int = 48, rounds: int = 3, most_share: float = 0.5, id_col: str = "chunk_id", text_col: str = "text", block_rows: int = 3_000_000, part_rows: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """The model, and the vectors of its own chunks, as embed makes them."""
    cut = stash(blocks(chunks, id_col, text_col, block_rows), "blocks")
    placed = stash(_placed(cut, most_share, part_rows), "vocabulary")
    asked = stash(_asked(cut, placed), "asked")
    v, turn = _started(placed, dims), np.eye(dims)
    for _ in range(rounds):
        v = stash(_round(cut, _sent(asked, v, turn), dims), "vectors")
        size, axes = np.linalg.eigh(_gram(v, dims))
        keep = size > max(size.max(), 0) * 1e-12
        turn = np.where(keep, axes / np.sqrt(np.where(keep, size, 1)), 0)[:, ::-1]  # the strongest first
    return stash(_model(placed, v, turn), "model"), _embedded(cut, _sent(asked, v, turn), dims, id_col)


def fit(chunks: DataFrame, dims: int = 48, rounds: int = 3, most_share: float = 0.5, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The model: word, idf, v (dims numbers)."""
    return fit_embed(chunks, dims, rounds, most_share, id_col, text_col)[0]


def embed(chunks: DataFrame, model: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """id_col, embedding (floats, of length one) of each chunk; null without a known word."""
    first = model.select(F.size("v").alias("n")).first()
    if first is None:
        return chunks.select(id_col).distinct().withColumn("embedding", F.lit(None).cast("array<float>"))
    cut = stash(blocks(chunks, id_col, text_col), "blocks")
    known = _own_words(cut).join(model, "word").select("block", "at", "idf", "v")
    return _embedded(cut, known, first["n"], id_col)
