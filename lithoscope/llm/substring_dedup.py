"""Substring dedup with repeated-phrase automata.

A window of 13 words is removed from a document when the same sequence also starts
in a document with a smaller id.  All steps pass between batches of about a
thousand documents and shards, never single documents, so a passage that a third
of all documents hold costs one small row a batch:

1. Each window has an anchor, the smallest hash of its four-word grams, which
   depends on the window alone.  A batch sends its distinct anchors, packed by hash.
2. Anchors seen twice go back to the batches that hold them.
3. A batch sends the distinct pieces of text around those anchors (all windows that
   share the anchor's place), compressed, to the shard of the anchor, with the
   smallest and largest document that holds the piece.
4. A shard confirms the windows that recur in two documents, comparing their words in
   full, and sends the recurring passages (runs of confirmed windows in a piece, with
   the smallest document of each window) to the batches that may hold them.
5. A batch compiles its passages, as sequences of word numbers, into Aho-Corasick
   automata of bounded size and streams the whole texts of its documents through them.
   Only what an automaton finds is an occurrence: the words covered by windows that an
   earlier document has are removed.

A batch has some megabytes of text, more in a larger corpus (`batch_bytes`), so that a
passage which all batches share brings a bounded number of copies to its shard.

Defined cases: a null or empty text has no words; a null id sorts last, and rows without
one are one document, as are rows that repeat an id; an id that is no number is refused
by the cast to long; a very long text is whole in one batch; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain, compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WINDOW, GRAM = 13, 4
PLACES = 3
_ROW = pa.schema([("_k", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("sha", pa.string())])


def places(w: C.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each piece: runs of windows of one text
    whose smallest gram (the leftmost of equals) is at the same place."""
    none = np.zeros(0, np.int64)
    n = len(w.hash) - window + 1
    if n <= 0:
        return none.astype(np.uint64), none, none
    v = C.rolling(w.hash, gram)
    p, width, wide = np.arange(len(v)), 1, window - gram + 1
    while width < wide:
        step = min(width, wide - width)
        a, b = p[:-step], p[step:]
        p = np.where(v[a] <= v[b], a, b)
        width += step
    whole = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    if not len(whole):
        return none.astype(np.uint64), none, none
    at = p[whole]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(whole) != 1)) + 1
    first = whole[np.concatenate(([0], cut))]
    last = whole[np.concatenate((cut - 1, [len(whole) - 1]))]
    return v[p[first]], first, last


def _u64(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in blobs]


def _texts(t: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    return t.column("_k").to_numpy(), C.text_bytes(t.column("_x"))


def _anchors(buckets: int):
    def run(key, table):
        ids, texts = _texts(table)
        rank = np.unique(ids, return_inverse=True)[1]
        found, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in C.blocks(texts):
            w = C.Words(texts[i:j])
            a, first, _ = places(w)
            found.append(a)
            docs.append(rank[i:j][w.doc[first]])
        h, d = np.concatenate(found), np.concatenate(docs)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        fresh = np.ones(len(h), bool)  # the first of each anchor and document
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        a, n = np.unique(h[fresh], return_counts=True)
        to = (a % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        rows = [(b, a[order[s:e]], n[order[s:e]] > 1) for b, s, e in zip(range(buckets), cuts[:-1], cuts[1:], strict=True) if s < e]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([key[0].as_py()] * len(rows), pa.int32()), "once": pa.array([r[1][~r[2]].tobytes() for r in rows], pa.binary()), "often": pa.array([r[1][r[2]].tobytes() for r in rows], pa.binary())})

    return run


def _recurring(key, table):
    once, often = _u64(table.column("once").to_pylist()), _u64(table.column("often").to_pylist())
    u, at, n = np.unique(np.concatenate(once + often), return_inverse=True, return_counts=True)
    keep = n > 1
    keep[np.searchsorted(u, np.concatenate(often))] = True
    mine = np.split(keep[at], np.cumsum([len(x) for x in once]))
    found = [(b, np.concatenate((x[k], y))) for b, x, y, k in zip(table.column("batch").to_pylist(), once, often, mine, strict=False)]
    found = [(b, x) for b, x in found if len(x)]
    return pa.table({"batch": pa.array([b for b, _ in found], pa.int32()), "anchors": pa.array([x.tobytes() for _, x in found], pa.binary())})


def _pieces(shards: int):
    def run(key, docs, back):
        ids, texts = _texts(docs)
        good = np.unique(np.concatenate(_u64(back.column("anchors").to_pylist()))) if back.num_rows else np.zeros(0, np.uint64)
        seen: dict[bytes, list] = {}
        for i, j in C.blocks(texts) if len(good) else ():
            w = C.Words(texts[i:j])
            a, first, last = places(w)
            ok = np.flatnonzero(good[np.minimum(np.searchsorted(good, a), len(good) - 1)] == a)
            for h, s, e, k in zip(a[ok].tolist(), w.start[first[ok]].tolist(), w.end[last[ok] + WINDOW - 1].tolist(), ids[i:j][w.doc[first[ok]]].tolist(), strict=True):
                t = w.text[s:e]
                x = seen.get(t)
                if x is None:
                    seen[t] = [h % shards, k, k]
                else:
                    x[1], x[2] = min(x[1], k), max(x[2], k)
        by: dict[int, list] = {}
        for t, (s, lo, hi) in seen.items():
            by.setdefault(s, []).append((t, lo, hi))
        rows = [(s, zlib.compress(b"\n".join([x[0] for x in xs]), 1), *[zlib.compress(np.array([x[c] for x in xs], np.int64).tobytes(), 1) for c in (1, 2)]) for s, xs in by.items()]
        made = {"shard": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([key[0].as_py()] * len(rows), pa.int32())}
        return pa.table(made | {n: pa.array([r[c] for r in rows], pa.binary()) for c, n in enumerate(("texts", "lo", "hi"), 1)})

    return run


def coded(numbers: np.ndarray, skip: np.ndarray, bits: int) -> str:
    """Word numbers as a string: PLACES characters each, of as many alphabets, so that
    nothing matches out of step; a space before each text."""
    places = np.empty((len(numbers), PLACES + 1), np.uint32)
    places[:, 0] = 32
    for c in range(1, PLACES + 1):
        places[:, c] = (c << bits) + 64 + ((numbers >> (bits * (PLACES - c))) & ((1 << bits) - 1))
    keep = np.ones(places.shape, bool)
    keep[:, 0] = skip
    return places[keep].astype("<u4").tobytes().decode("utf-32-le")


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


class Automata:
    """Aho-Corasick automata of some passages, each of at most `most` characters."""

    def __init__(self, passages: list[bytes], most: int = 2_000_000):
        sizes = np.fromiter((p.count(b" ") + 1 for p in passages), np.int64, len(passages))
        words = b" ".join(passages).split(b" ")
        self.number = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}  # 0: in no passage
        self.bits = max(7, -(-len(self.number).bit_length() // PLACES))  # few children a node
        self.sizes = sizes
        text = coded(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), np.zeros(len(words), bool), self.bits)
        ends = PLACES * starts_of(sizes)
        self.parts, now, size = [], ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
        for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if size and size + e - s > most:
                self.parts.append(now)
                now, size = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
            now.add_word(text[s:e], i)
            size += e - s
        self.parts.append(now)
        for a in self.parts:
            a.make_automaton()

    def occurrences(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first word, among all words of the texts, and passage of each."""
        n = sum(map(len, texts))
        numbers = np.fromiter(map(self.number.get, chain.from_iterable(texts), repeat(0)), np.int64, n)
        first = np.zeros(n, bool)
        first[starts_of(np.fromiter(map(len, [t for t in texts if t]), np.int64))[:-1]] = True
        text = coded(numbers, first, self.bits)
        where = PLACES * np.arange(n) + np.cumsum(first)  # of each word in the coded text
        found = [np.fromiter(a.iter(text), np.dtype((np.int64, 2))) for a in self.parts]
        hits = np.concatenate(found)
        return np.searchsorted(where, hits[:, 0] - PLACES * self.sizes[hits[:, 1]] + 1), hits[:, 1]


def _groups(nums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of the group of equal windows, compared in full."""
    for seed in range(1, 9):
        h = C.rolling(C.mix(nums.astype(np.uint64) + np.uint64(seed << 40)), WINDOW)[at]
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        same = at[first][group]
        if all(np.array_equal(nums[at + k], nums[same + k]) for k in range(WINDOW)):
            return first, group
    raise ValueError("windows collide under every seed")


def _confirm(key, table):
    """Of the pieces of a shard, the passages that recur, by batch: texts, how many windows
    each has, and the smallest document of each window."""
    batches = table.column("batch").to_pylist()
    cols = [[zlib.decompress(x) for x in table.column(c).to_pylist()] for c in ("texts", "lo", "hi")]
    lo, hi = (np.concatenate([np.frombuffer(x, np.int64) for x in c]) for c in cols[1:])
    row = np.repeat(np.arange(len(batches)), [len(x) // 8 for x in cols[1]])
    blob = b"\n".join(cols[0])
    texts = blob.split(b"\n")
    size = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
    del cols, texts
    blob = blob.replace(b"\n", b" ")
    words = blob.split(b" ")
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    nums = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    del words, number
    gaps = np.flatnonzero(np.frombuffer(blob, np.uint8) == 32)
    begin, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(blob)]))
    piece = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(piece[: len(piece) - WINDOW + 1] == piece[WINDOW - 1 :])  # the windows
    of = piece[at]
    first, group = _groups(nums, at)
    least, most = np.full(len(first), C.NO_ID), np.full(len(first), -(1 << 63))
    np.minimum.at(least, group, lo[of])
    np.maximum.at(most, group, hi[of])
    twice = (least != most)[group]  # confirmed: in two documents
    new = np.diff(of, prepend=-1) != 0
    s = np.flatnonzero(twice & (new | ~np.concatenate(([False], twice[:-1]))))
    e = np.flatnonzero(twice & (np.concatenate((new[1:], [True])) | ~np.concatenate((twice[1:], [False])))) + 1
    g = np.append(least[group], C.NO_ID)
    if len(s):
        useful = np.minimum.reduceat(g, np.stack((s, e), 1).ravel())[::2] < hi[of[s]]
        s, e = s[useful], e[useful]
    cuts = np.searchsorted(row[of[s]], np.arange(len(batches) + 1))
    made = []
    for r, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if i < j:
            runs = [blob[x:y] for x, y in zip(begin[at[s[i:j]]].tolist(), end[at[e[i:j] - 1] + WINDOW - 1].tolist(), strict=True)]
            spans = np.concatenate([g[x:y] for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)])
            made.append((batches[r], zlib.compress(b"\n".join(runs), 1), zlib.compress((e[i:j] - s[i:j]).astype(np.int32).tobytes(), 1), zlib.compress(spans.tobytes(), 1)))
    return pa.table({"batch": pa.array([m[0] for m in made], pa.int32())} | {n: pa.array([m[c] for m in made], pa.binary()) for c, n in enumerate(("passages", "sizes", "least"), 1)})


def _remove(key, docs, back):
    ids, texts = _texts(docs)
    passages: dict[bytes, np.ndarray] = {}
    for p, n, g in zip(*[[zlib.decompress(x) for x in back.column(c).to_pylist()] for c in ("passages", "sizes", "least")], strict=True):
        cuts, g = starts_of(np.frombuffer(n, np.int32)).tolist(), np.frombuffer(g, np.int64)
        passages.update(zip(p.split(b"\n"), [g[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
    automata = Automata(list(passages)) if passages else None
    least = np.concatenate([np.zeros(0, np.int64), *passages.values()])
    cuts = starts_of(np.fromiter(map(len, passages.values()), np.int64, len(passages)))
    n_words, gone, kept = [], [], []
    for i, j in C.blocks(texts):
        split = [t.split() for t in texts[i:j]]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        first = starts_of(counts)
        edge = np.zeros(int(first[-1]) + 1, np.int32)
        if automata and len(edge) > 1:
            at, which = automata.occurrences(split)
            n = cuts[which + 1] - cuts[which]  # windows of each occurrence
            step = np.arange(int(n.sum())) - np.repeat(starts_of(n)[:-1], n)
            window = np.repeat(at, n) + step
            ours = np.repeat(ids[i:j], counts)[window]
            window = np.unique(window[least[np.repeat(cuts[which], n) + step] < ours])
            np.add.at(edge, window, 1)
            np.add.at(edge, window + WINDOW, -1)
        stays = np.cumsum(edge[:-1]) == 0
        for k, w in enumerate(split):
            stay = stays[int(first[k]) : int(first[k + 1])]
            left = int(stay.sum())
            n_words.append(len(w))
            gone.append(len(w) - left)
            kept.append(b" ".join(compress(w, stay.tolist()) if left < len(w) else w))
    return pa.table([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], schema=_ROW)


def _grouped(f):
    def run(key, table):  # Spark counts the arguments
        return C.without_gc(f)(key, table)

    return run


def _cogrouped(f, drop: list[str] = ()):
    def run(key, docs, back):
        return C.without_gc(f)(key, docs, back).drop_columns(list(drop))

    return run


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_docs: int = 1000, batch_bytes: int | None = None, with_text: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256 and, if
    with_text, text_col: the words left, joined by one space.

    A batch has about `batch_docs` documents, or `batch_bytes` of text if that is less;
    if not given, the bytes grow with the corpus, from 4 to 32 MB, and documents with them."""
    spark = docs.sparkSession
    C.ship(spark)
    x = docs.select(C.key(id_col).alias("_k"), F.col(text_col).alias("_x"))
    size = x.agg(F.count("*").alias("n"), F.sum(F.octet_length("_x")).alias("b")).first()
    total = size["b"] or 0
    growth = min(8, max(1, total // (16 << 30)))  # batches of a corpus of over 16 GB are larger
    n = max(1, -(-size["n"] // (batch_docs * growth)), -(-total // (batch_bytes or growth * (4 << 20))))
    buckets, shards = max(24, -(-n // 8)), max(48, n)
    x = x.withColumn("batch", F.pmod(F.xxhash64("_k", "_x"), F.lit(n)).cast("int")).repartition("batch")
    by_batch = x.groupBy("batch")
    sent = by_batch.applyInArrow(_grouped(_anchors(buckets)), "bucket int, batch int, once binary, often binary")
    back = sent.groupBy("bucket").applyInArrow(_grouped(_recurring), "batch int, anchors binary")
    pieces = by_batch.cogroup(back.groupBy("batch")).applyInArrow(_cogrouped(_pieces(shards)), "shard int, batch int, texts binary, lo binary, hi binary")
    found = pieces.groupBy("shard").applyInArrow(_grouped(_confirm), "batch int, passages binary, sizes binary, least binary")
    out = by_batch.cogroup(found.groupBy("batch"))
    if with_text:
        done = out.applyInArrow(_cogrouped(_remove), "_k long, n_words long, n_removed long, kept binary, sha string")
    else:
        done = out.applyInArrow(_cogrouped(_remove, ["kept"]), "_k long, n_words long, n_removed long, sha string")
    cols = [C.id_of("_k").alias(id_col), "n_words", "n_removed", F.col("sha").alias("kept_sha256")]
    return done.select(*cols, *[F.col("kept").cast("string").alias(text_col)] if with_text else [])


def passages_sql(table: str = "documents") -> str:
    last = WINDOW - 1
    six = r"[\x20\x09-\x0D]+"
    return f"""
WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{six}'), lambda w: w <> '') AS w FROM {table}),
b AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {last}, 0) + 1)) AS i FROM a),
c AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {last}], ' ')) AS h FROM b),
d AS (SELECT h, min(doc_id) AS lo FROM c GROUP BY h HAVING count(DISTINCT doc_id) > 1),
e AS (SELECT doc_id, i FROM c JOIN d USING (h) WHERE doc_id > lo),
f AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM e),
g AS (SELECT a.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM a),
k AS (SELECT g.doc_id, string_agg(word, ' ' ORDER BY g.j) FILTER (WHERE f.j IS NULL) AS kept, count(f.j) AS n_removed
  FROM g LEFT JOIN f ON g.doc_id = f.doc_id AND g.j = f.j GROUP BY g.doc_id)
SELECT a.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM a LEFT JOIN k USING (doc_id)"""
