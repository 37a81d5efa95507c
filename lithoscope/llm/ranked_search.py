"""Ranked lexical search: document at a time over sharded, compressed postings.

1. Index.  Each task cuts the documents that it reads into shards of about
   `shard_bytes` of text; no text is shuffled.  Within a shard documents are in order of
   id, and known by their place in it.  A shard gives one row of its documents (ids and
   numbers of terms) and one per term: places as gaps and counts, each in the fewest
   bytes that hold the largest.  The index holds every document and every term, and is
   a table.
2. Statistics.  N and L are sums over the shards; df is a sum over a term's rows, of the
   items' terms only.
3. Search.  Items go in blocks of `block_items`; a block's weighted items meet the
   postings of its terms, and the documents, of each shard.  A heap merges the posting
   lists by place, so that each document is scored once, in order of id; a bounded heap
   holds the best by score, then id.  Lists whose largest contributions together can't
   exceed the worst of a full heap bring no document of their own: they leave the merge
   and are only looked up for documents that other lists bring.  No document that could
   rank is left out, so that the result is exact.
4. The best of all shards are merged by a window per item; Spark cuts each task's rows
   to the best per item before it shuffles them.

Defined cases: null or empty texts have no terms, and are found by no item; a very long
text is one document of a shard of its own; documents that repeat an id or a text are
ranked one by one, in any order where id and score are equal; a null id sorts last;
items that repeat id and text are one item, and those that repeat the id only are ranked
for each text; an item without terms has no rows; other columns are ignored, whatever
their names; an empty table of documents or items gives an empty result.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: ASCII letters and digits, and every byte of a character beyond ASCII, are part of a term.
_TERM = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_INDEX = "shard long, term binary, n long, places binary, counts binary"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
_HITS = pa.schema([("item", pa.int64()), ("key", pa.int64()), ("score", pa.int64())])
_WIDTHS = tuple(np.dtype(f"<u{w}") for w in (1, 2, 4, 8))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, in order: only A-Z are lower-cased."""
    return text.translate(_TERM).split()


def packed(x: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Runs of whole numbers of at least 0, each in the fewest bytes a number that hold its largest; the first byte tells how many."""
    if not len(starts):
        return []
    width = np.searchsorted([1 << 8, 1 << 16, 1 << 32], np.maximum.reduceat(x, starts), side="right")
    length, out = np.diff(np.append(starts, len(x))), [b""] * len(starts)
    for w, kind in enumerate(_WIDTHS):
        mine = np.flatnonzero(width == w)
        if len(mine):
            blob, mark = x[np.repeat(width == w, length)].astype(kind).tobytes(), bytes([w])
            ends = np.cumsum(length[mine]) * kind.itemsize
            for i, s, e in zip(mine.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = mark + blob[s:e]
    return out


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, _WIDTHS[x[0]], offset=1).astype(np.int64)


def postings(keys: list[int], texts: list[bytes]):
    """A shard's rows (term, n, places, counts); the first, without a term, has its documents."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    number: dict[bytes, int] = defaultdict(count().__next__)
    seen, sizes = array("q"), []
    for i in order:
        terms = terms_of(texts[i])
        sizes.append(len(terms))
        seen.extend(map(number.__getitem__, terms))
    sizes = np.array(sizes, np.int64)
    at = np.repeat(np.arange(len(order)), sizes)
    both, times = np.unique(np.frombuffer(seen, np.int64) * len(order) + at, return_counts=True)  # by term, then place
    term, place = np.divmod(both, len(order))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    gaps = np.diff(place, prepend=0)
    gaps[starts] = place[starts]
    yield None, int((sizes > 0).sum()), np.array([keys[i] for i in order], np.int64).tobytes(), packed(sizes, np.zeros(1, np.int64))[0]
    yield from zip(number, np.diff(np.append(starts, len(both))).tolist(), packed(gaps, starts), packed(times, starts), strict=True)


def _indexed(shard_bytes: int, shard_docs: int):
    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        keys, texts, size = [], [], 0

        def shard():
            rows = C.without_gc(lambda: list(postings(keys, texts)))()
            for i in range(0, len(rows), 10_000):
                cols = list(zip(*rows[i : i + 10_000], strict=True))
                number = [(task << 32) + made] * len(cols[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([number, *map(list, cols)], _INDEX_ARROW.types, strict=True)], schema=_INDEX_ARROW)

        for b in C.slices(batches):
            for k, t in zip(b.column("_k").to_pylist(), C.text_bytes(b.column("_x")), strict=True):
                if texts and (size + len(t) > shard_bytes or len(texts) >= shard_docs):
                    yield from shard()
                    keys, texts, size, made = [], [], 0, made + 1
                keys.append(k)
                texts.append(t)
                size += len(t)
        if texts:
            yield from shard()

    return run


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20, shard_docs: int = 1 << 16) -> DataFrame:
    """The index of docs, written to the shared folder; see above."""
    C.ship(docs.sparkSession)
    x = docs.select(C.key(id_col).alias("_k"), F.col(text_col).alias("_x"))
    return C.stash(x.mapInArrow(_indexed(shard_bytes, shard_docs), _INDEX), "postings")


class _List:
    """A term's postings in a shard: places, and what one weight of the term gives there."""

    def __init__(self, places: bytes, counts: bytes, damp: np.ndarray):
        at, tf = np.cumsum(unpacked(places)), unpacked(counts)
        part = 1_000_000_000 * tf // (1000 * tf + damp[at])
        self.at, self.part, self.most = at.tolist(), part.tolist(), int(part.max())


def best(lists: list[tuple[int, _List]], k: int) -> list[tuple[int, int]]:
    """The k best (score, place) of the lists, each with its weight: a heap merge by place."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].most)
    weight, at, part = [w for w, _ in lists], [x.at for _, x in lists], [x.part for _, x in lists]
    bound = [0]
    for w, x in lists:
        bound.append(bound[-1] + w * x.most)  # of this list and all before
    pos, first, worst, n = [0] * len(lists), 0, 0, len(lists)
    heap = [at[i][0] * n + i for i in range(n)]  # place and list as one number
    heapq.heapify(heap)
    found: list[tuple[int, int]] = []  # (score, -place): the worst is on top
    while first < n and bound[first + 1] <= worst:
        first += 1
    while heap and first < n:
        place, score, brought = heap[0] // n, 0, False
        end = (place + 1) * n
        while heap and heap[0] < end:
            i = heap[0] % n
            if i < first:  # has left the merge
                heapq.heappop(heap)
                continue
            p = pos[i]
            score += weight[i] * part[i][p]
            brought = True
            pos[i] = p = p + 1
            if p < len(at[i]):
                heapq.heapreplace(heap, at[i][p] * n + i)
            else:
                heapq.heappop(heap)
        if not brought:
            continue
        for i in range(first - 1, -1, -1):
            if score + bound[i + 1] <= worst:
                break  # even with all that is left
            p = pos[i] = bisect_left(at[i], place, pos[i])
            if p < len(at[i]) and at[i][p] == place:
                score += weight[i] * part[i][p]
        else:
            if score > worst:
                heapq.heappush(found, (score, -place))
                if len(found) > k:
                    heapq.heappop(found)
                if len(found) == k:
                    worst = found[0][0]
                    while first < n and bound[first + 1] <= worst:
                        first += 1
    return [(s, -p) for s, p in found]


def _searched(k: int, n_docs: int, n_terms: int):
    """The k best (item, key, score) of a shard for each item of a block."""

    def run(_, items: pa.Table, rows: pa.Table) -> pa.Table:
        lists: dict[bytes, _List] = {}
        terms, places, counts = (rows.column(c).to_pylist() for c in ("term", "places", "counts"))
        if None not in terms:
            return _HITS.empty_table()
        own = terms.index(None)
        keys, damp = np.frombuffer(places[own], np.int64), 12 * (100 - 25 + 25 * unpacked(counts[own]) * n_docs // max(1, n_terms))
        raw = {t: (p, c) for t, p, c in zip(terms, places, counts, strict=True) if t is not None}
        out: list[tuple[int, int, int]] = []
        for item, names, weights in zip(*[items.column(c).to_pylist() for c in ("item", "terms", "weights")], strict=True):
            mine = []
            for t, w in zip(names, weights, strict=True):
                if t in raw and w > 0:
                    if t not in lists:
                        lists[t] = _List(*raw[t], damp)
                    mine.append((w, lists[t]))
            out += [(item, int(keys[place]), score) for score, place in best(mine, k)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], schema=_HITS)

    return run


def terms_column(text: Column) -> Column:
    """The terms of a text by Spark's functions, for short texts such as items."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != "")


def search(postings: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", block_items: int = 1000) -> DataFrame:
    """item_col, rank, doc_id, score: each item's k best documents of an index."""
    about = postings.where("term IS NULL").select("shard", "n", "places", "counts")
    sizes = about.select("n", "counts").mapInArrow(_totals, "n long, terms long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    q = items.select(F.col(item_col).alias("_id"), F.col(text_col).alias("_x")).distinct()
    q = C.stash(q.select("_id", F.xxhash64("_id", "_x").alias("item"), terms_column(F.col("_x")).alias("terms")).where("size(terms) > 0"), "items")
    n_items = q.count()
    blocks = max(1, -(-n_items // block_items))
    q = q.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    terms = q.select("block", "item", F.explode("terms").alias("_t")).groupBy("block", "item", F.encode("_t", "UTF-8").alias("term")).agg(F.count("*").alias("times"))
    wanted = C.stash(terms.select("block", "term").distinct(), "item-terms")
    mine = C.stash(postings.join(wanted, "term"), "item-postings")
    df = mine.select("term", "shard", "n").distinct().groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * sizes["n"] + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weighted = terms.join(df, "term").groupBy("block", "item").agg(F.collect_list(F.struct("term", (F.col("times") * weight).cast("long").alias("w"))).alias("t"))
    weighted = C.stash(weighted.select("block", "item", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")), "weighted-items")
    # each item goes to every shard; salted, for all shards of a block share its number; not
    # broadcast, as there are the more salts the more shards
    salts = C.n_parts(postings.sparkSession)
    shards = about.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int"))
    salted = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = shards.select("shard", "block", "salt").join(salted.hint("merge"), ["block", "salt"]).select("shard", "block", "item", "terms", "weights")
    held = mine.select("shard", "block", "term", "places", "counts").union(shards.select("shard", "block", F.lit(None).cast("binary"), "places", "counts"))
    # as many tasks as set: the rows are few, but each shard is work
    asked, held = (x.repartition(salts, "shard", "block").groupBy("shard", "block") for x in (asked, held))
    hits = asked.cogroup(held).applyInArrow(_searched(k, sizes["n"], sizes["terms"]), "item long, key long, score long")
    ids = q.select("item", "_id")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "key")
    ranked = hits.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(ids, "item").select(F.col("_id").alias(item_col), "rank", C.id_of("key").alias("doc_id"), "score")


def _totals(batches):
    """Documents with a term, and all terms, of each shard."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("n"), pa.array([int(unpacked(x).sum()) for x in b.column("counts").to_pylist()], pa.int64())], names=["n", "terms"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Each item's k best documents; see above."""
    return search(index(docs), items, k)


def ranked_sql() -> str:
    """The same by sums over all postings."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
p AS (SELECT r, doc_id, w, count(*) AS tf, any_value(n) AS dn FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS w FROM d) GROUP BY r, doc_id, w),
f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
i AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS w FROM benchmark) GROUP BY item_id, w),
q AS (SELECT item_id, i.w, times * floor(1000 * ln((2.0 * n + 2) / (2.0 * df + 1)))::BIGINT AS weight FROM i JOIN f USING (w), s),
c AS (SELECT item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * dn * n) // l))))::BIGINT AS score FROM q JOIN p USING (w), s GROUP BY item_id, doc_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""
