"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's set is its distinct word shingles.  Documents with equal sets form a
   class; one row of each class goes on.
2. A sketch keeps the smallest `SKETCH` hashes of the set.  Inverted lists are keyed
   by two retained values that are neighbours in a sketch.  Of two sets with a
   similarity of 0.85 the first 32 values of the union hold such a pair, unless no
   two neighbours among them are shared: fewer than one pair in 10^11.  Sets with 32
   values or fewer are always found.  List rows are range-partitioned by key, size and
   document, so that a list of any length is cut over partitions; a list of at most
   `LONG` members that lies within a partition gives all its pairs.
3. Documents on other lists are searched again, exactly, among themselves: their whole
   sets are put in order of how many of these documents hold a shingle, rarest first,
   and each goes on the lists of its first 15 in 100 places and one more, where a pair
   that reaches the limit must meet.  A passage that many documents share thus comes
   last and brings nobody together.  The counts are made by batches of documents and
   buckets of hashes, packed.  Short lists give all pairs whose places allow the limit;
   of long ones each member is first paired with three pivots (stars).
4. A pair passes if the similarity estimated from the sketch of the union can reach the
   limit; what passes is verified on the full sets, read again from the texts.
5. Verified links give components.  Of long lists, then, who is not in the component
   that most of the list is in is compared with all members of other components, where
   places allow the limit.  No pair is dropped for the length of its list.

Components: each partition replaces its links by stars on the smallest id of what they
connect, links are dealt by their larger end, and so on until no document knows two
smaller ones; then the smaller ends are followed to the root.  A hub has at most one
link a partition after the first step.  Joins on documents or lists that many rows hold
have a unique other side, or are of a bounded one, and are left to Spark to split (skew
join).  Nothing but counts comes to the driver, and nothing is broadcast here.

Defined cases: without a word or text a set is empty, linked with nothing; with fewer
words than a shingle the whole sequence is the one shingle; rows that repeat an id
are one document, linked by the links of any of them; a null id sorts last, and rows
without one are one document; an id that is no number is refused by the cast to long;
other columns are ignored, whatever their names; a very long text is one row of one
task, with eight bytes a shingle; an empty table gives an empty result.  Sets are
compared as sets of 64-bit hashes of the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

SKETCH, FRONT, LONG = 96, 32, 32
#: Pairs of numbers.
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SALT = np.uint64(0x5851F42D4C957F2D)


def sets_of(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text, A-Z lower-cased."""
    w = C.Words(texts, lower=True)
    r = C.rolling(w.hash, shingle)
    out = []
    for d in range(len(texts)):
        s, e = int(w.first[d]), int(w.first[d + 1])
        if e - s >= shingle:
            out.append(np.unique(r[s : e - shingle + 1]))
        elif e > s:
            out.append(C.mix(C.rolling(w.hash[s:e], e - s) ^ _SALT))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: two sums of scrambled hashes, with its size."""
    n = np.uint64(len(s))
    a, b = (C.mix(C.mix(s ^ c) + n).sum(dtype=np.uint64) for c in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sketch(shingle: int):
    def run(batches):
        for b in C.slices(batches):
            texts, rows = C.text_bytes(b.column("_x")), []
            for i, j in C.blocks(texts):
                sets = sets_of(texts[i:j], shingle)
                rows += [(len(s), *_digest(s), s[:SKETCH].tobytes()) for s in sets]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            made = [pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_k"), *made], names=["_k", "n", "d1", "d2", "sk"])

    return run


def _keys(front: int, gram: int):
    """(key, node, n) for each `gram` neighbours among the first values of a sketch."""

    def run(batches):
        for b in batches:
            nodes, sizes, out = b.column("node").to_pylist(), b.column("n").to_pylist(), []
            for sk in b.column("sk").to_pylist():
                out.append(np.unique(C.rolling(np.frombuffer(sk, np.uint64)[:front], gram)).view(np.int64))
            n = [len(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), n)), pa.array(np.repeat(np.array(sizes, np.int64), n))], names=["key", "node", "n"])

    return run


def _estimate(num: int, den: int):
    """Keep pairs whose union sketch allows the limit: six standard deviations below
    it, and exact where a sketch holds its whole set."""

    def run(batches):
        for b in batches:
            keep = []
            for n1, n2, x, y in zip(*[b.column(c).to_pylist() for c in ("n_a", "n_b", "sk_a", "sk_b")], strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(s, t, assume_unique=True)
                if n1 <= SKETCH and n2 <= SKETCH:
                    keep.append(den * len(both) >= num * (n1 + n2 - len(both)))
                    continue
                u = np.union1d(s, t)
                k = min(len(u), SKETCH)
                p = num / den
                keep.append(np.searchsorted(both, u[k - 1], side="right") >= k * (p - 6 * (p * (1 - p) / k) ** 0.5))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _verify(shingle: int, num: int, den: int):
    """Rows come sorted by b, so that a hub's set is made once for each block of rows."""

    def run(batches):
        for b in C.slices(batches):
            x, y, found = C.text_bytes(b.column("xa")), C.text_bytes(b.column("xb")), []
            for i, j in C.blocks([s if len(s) > len(t) else t for s, t in zip(x, y, strict=True)]):
                texts = list(dict.fromkeys(x[i:j] + y[i:j]))
                sets = dict(zip(texts, sets_of(texts, shingle), strict=True))
                for s, t in zip(x[i:j], y[i:j], strict=True):
                    s, t = sets[s], sets[t]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    found.append(both > 0 and den * both >= num * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return run


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)


def _short_pairs(num: int, den: int):
    """Rows come sorted by key, size and node.  All pairs of lists within this partition
    that are not long, as (a, b); of others the members, as (a, null)."""

    def run(batches):
        cols = ("key", "n", "node")
        rest = [np.zeros(0, np.int64)] * 3
        edge = True  # the first run may have begun in the partition before

        def made(keys, n, node, ends, edge_first, edge_last):
            length = np.diff(ends)
            lone = length > LONG
            if len(length) and edge_first:
                lone[0] = True
            if len(length) and edge_last:
                lone[-1] = True
            crowded = node[np.repeat(lone, length)]
            a, b = [], []
            for at in np.flatnonzero(~lone & (length > 1)).tolist():
                s, e = int(ends[at]), int(ends[at + 1])
                i, j = _UPPER[e - s]
                fits = den * n[s + i] >= num * n[s + j]  # sorted by size
                a.append(node[s + i[fits]])
                b.append(node[s + j[fits]])
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
            first = pa.array(np.concatenate((np.minimum(a, b), crowded)))
            second = np.concatenate((np.maximum(a, b), crowded))
            none = np.concatenate((np.zeros(len(a), bool), np.ones(len(crowded), bool)))
            return pa.RecordBatch.from_arrays([first, pa.array(second, mask=none)], schema=_PAIRS)

        for x in batches:
            now = [np.concatenate((r, x.column(c).to_numpy())) for r, c in zip(rest, cols, strict=True)]
            ends = _runs(now[0])
            if len(ends) < 3:
                rest = now
                continue
            cut = int(ends[-2])
            yield made(*[c[:cut] for c in now], ends[:-1], edge, False)
            rest, edge = [c[cut:] for c in now], False
        if len(rest[0]):
            yield made(*rest, _runs(rest[0]), edge, True)

    return run


_UPPER = [np.triu_indices(k, 1) for k in range(LONG + 1)]


def _counts(shingle: int, buckets: int):
    """A batch's distinct shingles and how many of its documents hold each, packed by
    bucket of the hash."""

    def run(key, docs):
        texts = C.text_bytes(docs.column("_x"))
        sets = [s for i, j in C.blocks(texts) for s in sets_of(texts[i:j], shingle)]
        u, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        to = (u % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        rows = [(b, u[order[s:e]].tobytes(), n[order[s:e]].astype(np.uint32).tobytes()) for b, s, e in zip(range(buckets), cuts[:-1], cuts[1:], strict=True) if s < e]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([key[0].as_py()] * len(rows), pa.int32()), "values": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _totals(key, table):
    """For each batch, those of its shingles that two documents hold, with the total."""
    vs = [np.frombuffer(x, np.uint64) for x in table.column("values").to_pylist()]
    u, at = np.unique(np.concatenate(vs), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]), len(u)).astype(np.uint32)
    mine = np.split(total[at], np.cumsum([len(v) for v in vs])[:-1])
    rows = [(b, v[t > 1].tobytes(), t[t > 1].tobytes()) for b, v, t in zip(table.column("batch").to_pylist(), vs, mine, strict=True) if (t > 1).any()]
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int32()), "values": pa.array([r[1] for r in rows], pa.binary()), "totals": pa.array([r[2] for r in rows], pa.binary())})


def _prefixes(shingle: int, num: int, den: int):
    """(key, node, n, pos) for the first places of each document, rarest first, but for
    what no other document holds."""

    def run(key, docs, back):
        known = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in back.column("values").to_pylist()]])
        total = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(x, np.uint32) for x in back.column("totals").to_pylist()]])
        order = np.argsort(known)
        known, total = np.concatenate((known[order], [np.uint64((1 << 64) - 1)])), np.concatenate((total[order], [np.uint32(1)]))
        texts, ids = C.text_bytes(docs.column("_x")), docs.column("_k").to_numpy()
        keys, nodes, sizes, places = [], [], [], []
        for i, j in C.blocks(texts):
            for k, s in zip(ids[i:j], sets_of(texts[i:j], shingle), strict=True):
                at = np.searchsorted(known, s)
                df = np.where(known[at] == s, total[at], 1)
                front = np.lexsort((s, df))[: len(s) + num * len(s) // -den + 1]
                place = np.flatnonzero(df[front] > 1)
                keys.append(s[front[place]].view(np.int64))
                places.append(place)
                nodes.append(np.full(len(place), k, np.int64))
                sizes.append(np.full(len(place), len(s), np.int64))
        join = lambda xs: pa.array(np.concatenate([np.zeros(0, np.int64), *xs]).astype(np.int64), pa.int64())
        return pa.table({"key": join(keys), "node": join(nodes), "n": join(sizes), "pos": join(places)})

    return run


def _reaches(n, m, i, j, num: int, den: int):
    """Whether sets of n and m whose first common shingle is at places i and j can be
    that similar: what follows bounds what they share."""
    return (num + den) * min(n - i, m - j) >= num * (n + m)


def _placed_pairs(num: int, den: int):
    """All pairs of a short list whose sizes and places allow the limit.  Rows come
    sorted by key."""

    def run(batches):
        last, rows = None, []

        def pairs():
            return [(min(a, b), max(a, b)) for x, (a, n, i) in enumerate(rows) for b, m, j in rows[x + 1 :] if a != b and den * min(n, m) >= num * max(n, m) and _reaches(n, m, i, j, num, den)]

        def made(found):
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], schema=_PAIRS)

        for b in batches:
            found = []
            for k, a, n, i in zip(*[b.column(x).to_pylist() for x in ("key", "node", "n", "pos")], strict=True):
                if k != last:
                    found += pairs()
                    last, rows = k, []
                rows.append((a, n, i))
            yield made(found)
        if found := pairs():
            yield made(found)

    return run


def stars(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the links connect, as (larger, smallest of its component)."""
    ids, at = np.unique(np.concatenate((hi, lo)), return_inverse=True)
    x, y = at[: len(hi)], at[len(hi) :]
    label = np.arange(len(ids))
    while True:
        p, q = label[x], label[y]
        open_ = np.flatnonzero(p != q)
        if not len(open_):
            break
        least = np.minimum(p[open_], q[open_])
        np.minimum.at(label, p[open_], least)
        np.minimum.at(label, q[open_], least)
        while not np.array_equal(label, nxt := label[label]):
            label = nxt
    out = np.flatnonzero(label != np.arange(len(ids)))
    return ids[out], ids[label[out]]


def _contract(whole: bool, most: int = 1 << 20):
    """Links to stars, (hi, lo, many).  whole: the partition has all links of a larger end,
    and `many` tells whether any knew two smaller ones; else in blocks of bounded size."""

    def run(batches):
        got, n = [], 0

        def made():
            hi, lo = (np.concatenate(x) for x in zip(*got, strict=True))
            both = np.unique(np.stack((hi, lo)), axis=1)
            many = whole and bool((np.diff(both[0]) == 0).any())
            u, v = stars(both[0], both[1])
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), many))], names=["hi", "lo", "many"])

        for b in batches:
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep = x != y
            if keep.any():
                got.append((np.maximum(x, y)[keep], np.minimum(x, y)[keep]))
                n += int(keep.sum())
            if n >= most and not whole:
                yield made()
                got, n = [], 0
        if got:
            yield made()

    return run


class _Search:
    """The candidate search and its tables, for one call."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, shingle: int, num: int, den: int):
        self.docs, self.nodes = docs, nodes
        self.shingle, self.num, self.den = shingle, num, den
        self.parts = C.n_parts(docs.sparkSession)

    def prefix_keys(self, crowded: DataFrame, batch_docs: int = 500, batch_bytes: int = 4 << 20) -> DataFrame:
        """(key, node, n, pos) of the texts of some nodes, in batches bounded by documents
        and, but for a single long one, by bytes."""
        x = self.texts.join(crowded.withColumnRenamed("node", "_k"), "_k", "left_semi")
        size = x.agg(F.count("*").alias("n"), F.sum(F.octet_length("_x")).alias("b")).first()
        n = max(1, -(-size["n"] // batch_docs), -(-(size["b"] or 0) // batch_bytes))
        buckets = max(24, -(-n // 4))
        by_batch = x.withColumn("batch", F.pmod(F.xxhash64("_k", "_x"), F.lit(n)).cast("int")).repartition("batch").groupBy("batch")
        sent = by_batch.applyInArrow(_counts(self.shingle, buckets), "bucket int, batch int, values binary, counts binary")
        back = sent.groupBy("bucket").applyInArrow(_totals, "batch int, values binary, totals binary")
        return by_batch.cogroup(back.groupBy("batch")).applyInArrow(_prefixes(self.shingle, self.num, self.den), "key long, node long, n long, pos long")

    def near(self, pairs: DataFrame, name: str) -> DataFrame:
        """Stars of the pairs (a, b), in any order, that pass the estimate and the full sets."""
        x = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for c in ("a", "b"):
            x = x.join(self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sk").alias(f"sk_{c}")), c)
        x = x.where(F.least("n_a", "n_b") * self.den >= F.greatest("n_a", "n_b") * self.num)
        x = x.select("a", "b", "n_a", "n_b", "sk_a", "sk_b").mapInArrow(_estimate(self.num, self.den), "a long, b long")
        for c in ("a", "b"):
            x = x.join(self.texts.select(F.col("_k").alias(c), F.col("_x").alias(f"x{c}")), c)
        verify, contract = _verify(self.shingle, self.num, self.den), _contract(False)
        return C.stash(x.select("a", "b", "xa", "xb").mapInArrow(lambda rows: contract(verify(rows)), "hi long, lo long, many boolean"), name)

    def components(self, links: DataFrame) -> DataFrame:
        """node, comp for every node with a smaller one in its component: the smallest."""
        e = links.select("hi", "lo")
        while True:
            e = C.stash(e.repartition(self.parts, "hi").mapInArrow(_contract(True), "hi long, lo long, many boolean"), "stars")
            if not e.where("many").limit(1).count():
                break
            e = e.select("hi", "lo")
        e = e.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
        while True:
            up = e.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            if not e.join(up, "comp", "left_semi").limit(1).count():
                return e
            e = C.stash(e.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "roots")

    def links(self) -> DataFrame:
        keys = self.nodes.select("node", "n", "sk").mapInArrow(_keys(FRONT, 2), "key long, node long, n long")
        keys = keys.repartitionByRange(self.parts, "key", "n", "node").sortWithinPartitions("key", "n", "node")
        found = C.stash(keys.mapInArrow(_short_pairs(self.num, self.den), "a long, b long"), "candidates")
        pairs = found.where("b IS NOT NULL")
        crowded = found.where("b IS NULL").select(F.col("a").alias("node")).distinct()
        # Texts that are read again: of documents with a candidate.
        wanted = pairs.select(F.col("a").alias("_k")).union(pairs.select("b")).union(crowded).distinct()
        self.texts = C.stash(self.docs.join(wanted, "_k", "left_semi"), "texts")
        if not crowded.limit(1).count():
            return self.near(pairs, "links").select("hi", "lo")
        places = C.stash(self.prefix_keys(crowded), "places")
        about = places.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("pos", "node")).alias("f"), F.min("node").alias("p2"), F.max("node").alias("p3")).where("size > 1")
        members = places.join(about.select("key", "size", F.col("f.node").alias("p1"), "p2", "p3"), "key")
        short = members.where(F.col("size") <= LONG).select("key", "node", "n", "pos")
        short = short.repartition(self.parts, "key").sortWithinPartitions("key").mapInArrow(_placed_pairs(self.num, self.den), "a long, b long")
        long = members.where(F.col("size") > LONG)
        star = long.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("b"))
        links = self.near(pairs.union(short).union(star), "links")
        if not long.limit(1).count():
            return links.select("hi", "lo")
        comps = self.components(links)
        m = C.stash(long.select("key", "node", "n", "pos").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "long")
        most = m.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("most"))
        other = m.join(most, "key").where("comp <> most")
        side = lambda x, c: x.select("key", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("pos").alias(f"i_{c}"), F.col("comp").alias(f"c_{c}"))
        n, k, i, j = F.col("n_a"), F.col("n_b"), F.col("i_a"), F.col("i_b")
        fits = (F.col("c_a") != F.col("c_b")) & (F.least(n, k) * self.den >= F.greatest(n, k) * self.num) & (F.least(n - i, k - j) * (self.num + self.den) >= (n + k) * self.num)
        more = side(other, "a").join(side(m, "b"), "key").where(fits).select("a", "b")
        return comps.select(F.col("node").alias("hi"), F.col("comp").alias("lo")).union(self.near(more, "more-links").select("hi", "lo"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, limit: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id
    reachable over links of at least limit[0] / limit[1] Jaccard), kept."""
    spark = docs.sparkSession
    C.ship(spark)
    num, den = limit
    x = docs.select(C.key(id_col).alias("_k"), F.col(text_col).alias("_x"))
    base = C.stash(x.mapInArrow(_sketch(shingle), "_k long, n long, d1 long, d2 long, sk binary"), "sketches")
    full = base.where("n > 0")
    nodes = C.stash(full.groupBy("d1", "d2").agg(F.min("_k").alias("node"), F.first("n").alias("n"), F.first("sk").alias("sk")), "classes")
    search = _Search(x, nodes, shingle, num, den)
    links = search.links()
    # Rows of one id with several sets tie their classes together.
    both = F.struct("d1", "d2")
    repeated = full.groupBy("_k").agg(F.min(both).alias("lo"), F.max(both).alias("hi")).where("lo <> hi").select("_k")
    if repeated.limit(1).count():
        ties = full.join(repeated, "_k").select("_k", "d1", "d2").distinct().join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
        links = links.union(ties.select("_k", "node").mapInArrow(_contract(False), "hi long, lo long, many boolean").select("hi", "lo"))
    comps = search.components(links)
    named = nodes.select("node", "d1", "d2").join(comps, "node", "left").select("d1", "d2", F.coalesce("comp", "node").alias("comp"))
    out = full.select("_k", "n", "d1", "d2").join(named, ["d1", "d2"]).select("_k", "n", "comp")
    out = out.unionByName(base.where("n = 0").select("_k", "n", F.col("_k").alias("comp")))
    return out.select(C.id_of("_k").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("comp") != C.NO_ID, F.col("comp")).alias("component_id"), (F.col("_k") == F.col("comp")).alias("kept"))
