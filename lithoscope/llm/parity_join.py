"""N-gram Jaccard join by parity sketches.

1. A document's set is its distinct word shingles.  Documents with equal sets form a
   class; one row of each class, a node, goes on.
2. Sets of n and m that reach the limit p differ in at most (n+m)(1-p)/(1+p) shingles,
   and the smaller has at least p times the larger's size.  Sizes fall into bands; a
   node is at home in one, and also visits the next if a partner of its may live there.
3. A parity sketch cuts the range of hashes into as many blocks as the band's largest
   sets may differ in, and a few more; each shingle flips one of the 64 bits of its
   block.  The Hamming distance of two sketches is then a lower bound of the symmetric
   difference, and a shingle in which sets differ spoils one block.
4. Pigeonhole: a pair has an equal block among the first D+1, D being the most that it
   may differ in.  A block's key is the XOR of its shingles' hashes.  A block with fewer
   than `FEW` shingles would bring strangers together.  A node therefore keys `slack`
   more blocks and leaves the poor ones out; a pair can be lost by that only if both
   have more poor blocks than slack.  Such nodes, which are rare, also key the shingles
   of their prefix, in order of hash, where two of them must meet.  No pair is lost.
5. Rows (block, node) are range-partitioned by key, size and node, so that a list of
   any length is cut over partitions.  A list of at most `LONG` members within a
   partition gives its pairs; members of a longer one are paired with its least and
   its largest node.
6. A candidate passes if the Hamming distances allow the limit, of a small sketch first,
   so that few large ones are sent, and is then verified on the full sets, made again from
   the texts.  First each node's least partner is tried,
   then pairs whose ends are not yet connected.  Pairs within a component need no test:
   the result is components.
7. Long lists whose members are still in several components hold templates with too many
   differences.  Their members are searched once more, exactly: shingles that none other of
   them holds use up the differences that a node may have, and who has too many has no
   partner.  So each goes, rarest shingle first, on the lists of its prefix, where partners
   must meet; of these again short lists give their pairs, and of long ones who is not
   in the component of most of the list is compared with the members of others, where
   sizes and places allow the limit.

Defined cases: without a word or text a set is empty, linked with nothing; with fewer
words than a shingle the whole sequence is the one shingle; rows that repeat an id are
one document, linked by the links of any of them; a null id sorts last, and rows
without one are one document; an id that is no number is refused by the cast to long;
other columns are ignored, whatever their names; a very long text is one row of one
task, with a few bytes a shingle; an empty table gives an empty result.  Sets are
compared as sets of 64-bit hashes of the shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .minhash_dedup import _contract, _digest, _placed_pairs, _runs, _Search, _verify, sets_of

#: Least shingles of a block that is keyed, most members of a list that gives all pairs, and
#: words of a small sketch of the whole set, the same for all bands.
FEW, LONG, SMALL = 2, 16, 8
#: Ids that are broadcast at most, of eight bytes each.
MOST_SENT = 1_000_000
_ROWS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_UPPER = [np.triu_indices(k, 1) for k in range(LONG + 1)]


class Bands:
    """Sizes, blocks and distances for a limit of num / den."""

    def __init__(self, num: int, den: int):
        # no partner lives further than in the next band
        self.num, self.den, self.growth = num, den, max(1.4, den / num)

    def start(self, band: int) -> int:
        """The least size of a band."""
        return math.ceil(self.growth**band - 1e-9)

    def of(self, n: int) -> int:
        band = max(0, int(math.log(n, self.growth)))
        while self.start(band) > n:
            band -= 1
        while self.start(band + 1) <= n:
            band += 1
        return band

    def apart(self, total: int) -> int:
        """The most shingles in which linked sets with `total` together differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def largest(self, n: int) -> int:
        """The largest set that a set of n can be linked with."""
        return n * self.den // self.num

    def smallest(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def slack(self, differ: int) -> int:
        """Blocks beyond differ+1 that make up for poor ones, but for rare nodes."""
        poor = 0.01 * differ
        return math.ceil(poor + 4 * math.sqrt(poor) + 2)

    def blocks(self, band: int) -> int:
        most = self.apart(2 * (self.start(band + 1) - 1))
        return most + 1 + self.slack(most)

    def homes(self, n: int) -> list[int]:
        """The bands in which a set of n has a sketch: its own, and the next if partners live there."""
        band = self.of(n)
        return [band] if self.largest(n) < self.start(band + 1) else [band, band + 1]


def block_of(s: np.ndarray, blocks: int) -> np.ndarray:
    return ((s >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def cut_xor(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the values of each block."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(values)))
    return upto[ends[1:]] ^ upto[ends[:-1]]


def parity(s: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch of a set of ascending hashes, each flips one bit of its block, and where blocks end."""
    ends = np.searchsorted(block_of(s, blocks), np.arange(blocks + 1))
    return cut_xor(np.uint64(1) << (s & np.uint64(63)), ends), ends


def small(s: np.ndarray) -> np.ndarray:
    """A parity sketch of `SMALL` words, whatever the size of the set."""
    out = np.zeros(SMALL, np.uint64)
    np.bitwise_xor.at(out, (s >> np.uint64(8)) % np.uint64(SMALL), np.uint64(1) << (s & np.uint64(63)))
    return out


def keys_of(s: np.ndarray, bands: Bands) -> tuple[list[np.ndarray], np.ndarray]:
    """A set's sketch for each of its bands, and the keys by which partners meet it."""
    n, sketches, keys, rare = len(s), [], [], False
    differ = bands.apart(n + bands.largest(n))
    few = bands.slack(bands.apart(n + bands.smallest(n)))
    mixed = C.mix(s)
    for band in bands.homes(n):
        total = bands.blocks(band)
        sketch, ends = parity(s, total)
        sketches.append(sketch)
        if differ:  # else only an equal set is near enough, and that is the same class
            first = min(total, differ + 1 + bands.slack(differ))
            rich = np.diff(ends)[:first] >= FEW
            own = C.mix(np.arange(first, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40)))
            keys.append(C.mix(cut_xor(mixed, ends)[:first] ^ own)[rich])
            rare |= int((~rich).sum()) > few
    if rare:
        keys.append(C.mix(~mixed[: n - bands.smallest(n) + 1]))
    return sketches, np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)


def _sketches(shingle: int, bands: Bands):
    """(_k, n, digest, sketches, keys) of each text; sketches and keys packed."""

    def run(batches):
        for b in C.slices(batches):
            texts, rows = C.text_bytes(b.column("_x")), []
            for i, j in C.blocks(texts):
                for s in sets_of(texts[i:j], shingle):
                    made, keys = keys_of(s, bands) if len(s) else ([], s)
                    home, visit = [*(x.tobytes() for x in made), b"", b""][:2]
                    rows.append((len(s), *_digest(s), small(s).tobytes(), home, visit, keys.tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4
            made = [pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_k"), *made], names=["_k", "n", "d1", "d2", "small", "home", "visit", "keys"])

    return run


def _exploded(batches):
    """(key, node, n) of packed keys."""
    for b in C.slices(batches):
        keys = [np.frombuffer(x, np.int64) for x in b.column("keys").to_pylist()]
        count = [len(x) for x in keys]
        nodes, n = (np.repeat(b.column(c).to_numpy(), count) for c in ("node", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(nodes), pa.array(n)], names=["key", "node", "n"])


def _listed(num: int, den: int):
    """Rows come sorted by key, size and node.  Of lists within this partition that are
    not long all pairs, (null, a, b, null); of others the members, (key, node, null, n)."""

    def made(keys, n, node, ends, edge_first, edge_last):
        length = np.diff(ends)
        lone = length > LONG
        lone[0] |= edge_first
        lone[-1] |= edge_last
        member = np.repeat(lone, length)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in np.flatnonzero(~lone & (length > 1)).tolist():
            s, e = int(ends[at]), int(ends[at + 1])
            i, j = _UPPER[e - s]
            fits = den * n[s + i] >= num * n[s + j]
            a.append(node[s + i[fits]])
            b.append(node[s + j[fits]])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs, members = len(a), int(member.sum())
        is_pair = np.arange(pairs + members) < pairs
        col = lambda x, y, mask=None: pa.array(np.concatenate((x, y)), pa.int64(), mask=mask)
        none, fill = np.zeros(pairs, np.int64), np.zeros(members, np.int64)
        return pa.RecordBatch.from_arrays([col(none, keys[member], is_pair), col(np.minimum(a, b), node[member]), col(np.maximum(a, b), fill, ~is_pair), col(none, n[member], is_pair)], schema=_ROWS)

    def run(batches):
        rest, edge = [np.zeros(0, np.int64)] * 3, True  # the first list may have begun in the partition before
        for x in batches:
            now = [np.concatenate((r, x.column(c).to_numpy())) for r, c in zip(rest, ("key", "n", "node"), strict=True)]
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


def distance(bands: Bands, n: tuple[int, int], home: tuple[bytes, bytes], visit: tuple[bytes, bytes]) -> int | None:
    """The Hamming distance of two nodes' sketches of the larger one's band; None if one
    has no sketch there."""
    own = [bands.of(x) for x in n]
    x, y = (home[i] if own[i] == max(own) else visit[i] if own[i] + 1 == max(own) else b"" for i in (0, 1))
    return int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()) if x and y else None


def _allowed(bands: Bands, whole: bool):
    """Pairs whose Hamming distance allows them to pass: that of the sketches of their band
    or, unless whole, of the small ones."""

    def near(n: int, m: int, *sketches: bytes) -> bool:
        if whole:
            far = distance(bands, (n, m), sketches[:2], sketches[2:])
        else:
            far = int(np.bitwise_count(np.frombuffer(sketches[0], np.uint64) ^ np.frombuffer(sketches[1], np.uint64)).sum())
        return far is not None and far <= bands.apart(n + m)

    names = ["n_a", "n_b", *(("home_a", "home_b", "visit_a", "visit_b") if whole else ("small_a", "small_b"))]

    def run(batches):
        for b in C.slices(batches):
            keep = [near(*x) for x in zip(*[b.column(c).to_pylist() for c in names], strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Join:
    """The candidate pairs of one call, tried in steps."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, shingle: int, bands: Bands):
        self.docs, self.nodes, self.shingle, self.bands = docs, nodes, shingle, bands
        self.parts = C.n_parts(docs.sparkSession)
        self.search = _Search(docs, nodes, shingle, bands.num, bands.den)

    def allowed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose sizes and sketches allow the limit."""
        x = self._with(pairs, self.nodes, "node", "n", "small").where(F.least("n_a", "n_b") * self.bands.den >= F.greatest("n_a", "n_b") * self.bands.num)
        x = C.stash(x.mapInArrow(_allowed(self.bands, False), "a long, b long").distinct(), f"{name}-small")
        x = self._with(x, self.nodes, "node", "n", "home", "visit").mapInArrow(_allowed(self.bands, True), "a long, b long")
        return C.stash(x.distinct(), f"{name}-allowed")

    @staticmethod
    def _with(pairs: DataFrame, table: DataFrame, key: str, *cols: str) -> DataFrame:
        """Pairs with columns of both ends.  Each end takes its own, then they meet: where
        pairs are few, Spark sends them and not the table."""
        end = lambda c: table.select(F.col(key).alias(c), *[F.col(v).alias(f"{v}_{c}") for v in cols]).join(pairs, c)
        return end("a").join(end("b"), ["a", "b"])

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Stars (hi, lo) of what the pairs that pass on their full sets connect."""
        x = self._with(self.allowed(pairs, name), self.search.texts, "_k", "_x")
        verify, contract = _verify(self.shingle, self.bands.num, self.bands.den), _contract(False)
        x = x.select("a", "b", F.col("_x_a").alias("xa"), F.col("_x_b").alias("xb"))
        return C.stash(x.mapInArrow(lambda rows: contract(verify(rows)), "hi long, lo long, many boolean"), name).select("hi", "lo")

    def named(self, x: DataFrame, comps: DataFrame, col: str) -> DataFrame:
        """x with the component of a column's node as c_<col>."""
        at = comps.select(F.col("node").alias(col), F.col("comp").alias(f"c_{col}"))
        return x.join(at, col, "left").withColumn(f"c_{col}", F.coalesce(f"c_{col}", col))

    def links(self) -> DataFrame:
        keys = self.nodes.select("node", "n", "keys").mapInArrow(_exploded, "key long, node long, n long")
        keys = keys.repartitionByRange(self.parts, "key", "n", "node").sortWithinPartitions("key", "n", "node")
        found = C.stash(keys.mapInArrow(_listed(self.bands.num, self.bands.den), "key long, a long, b long, n long"), "lists")
        about = found.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("size"), F.min("a").alias("p1"), F.max("a").alias("p2")).where("size > 1")
        members = C.stash(found.select("key", F.col("a").alias("node"), "n").join(about, "key"), "members")
        star = members.select("node", F.explode(F.array("p1", "p2")).alias("p")).where("node <> p")
        pairs = found.where("b IS NOT NULL").select("a", "b").union(star.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")))
        pairs = C.stash(pairs.distinct(), "pairs")
        wanted = C.stash(pairs.select(F.col("a").alias("_k")).union(pairs.select("b")).distinct(), "wanted")
        if wanted.count() <= MOST_SENT:  # so many ids are sent, and no text is shuffled to meet them
            wanted = F.broadcast(wanted)
        self.search.texts = C.stash(self.docs.join(wanted, "_k", "left_semi"), "texts")
        # few nodes have a candidate: the others' sketches are sent no more
        slim = self.nodes.select("node", "n", "small", "home", "visit")
        self.nodes = C.stash(slim.join(wanted.withColumnRenamed("_k", "node"), "node", "left_semi"), "near-nodes")
        links = self.verified(pairs.groupBy("b").agg(F.min("a").alias("a")), "least-links")
        comps = self.search.components(links)
        rest = self.named(self.named(pairs, comps, "a"), comps, "b").where("c_a <> c_b").select("a", "b")
        links = links.union(self.verified(rest, "more-links"))
        more = self.scattered(members, self.search.components(links))
        return links if more is None else links.union(self.verified(more, "last-links"))

    def scattered(self, members: DataFrame, comps: DataFrame) -> DataFrame | None:
        """Pairs of different components from long lists that hold several of them."""
        m = self.named(members.where("size > 2"), comps, "node")
        split = m.groupBy("key").agg(F.min("c_node").alias("lo"), F.max("c_node").alias("hi")).where("lo <> hi").select("key")
        crowded = C.stash(members.join(split, "key", "left_semi").select("node").distinct(), "crowded")
        if not crowded.limit(1).count():
            return None
        x = self.named(C.stash(self.search.prefix_keys(crowded), "places"), comps, "node").withColumnRenamed("c_node", "comp")
        lists = x.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        x = C.stash(x.join(lists.select("key", "size"), "key"), "split-lists")
        short = x.where(F.col("size") <= LONG).select("key", "node", "n", "pos")
        short = short.repartition(self.parts, "key").sortWithinPartitions("key").mapInArrow(_placed_pairs(self.bands.num, self.bands.den), "a long, b long")
        short = self.named(self.named(short.distinct(), comps, "a"), comps, "b").where("c_a <> c_b").select("a", "b")
        long = x.where(F.col("size") > LONG)
        most = long.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("most"))
        side = lambda x, c: x.select("key", *[F.col(v).alias(f"{v}_{c}") for v in ("node", "n", "comp", "pos")])
        num, den, n, k = self.bands.num, self.bands.den, F.col("n_x"), F.col("n_y")
        reach = F.least(n - F.col("pos_x"), k - F.col("pos_y")) * (num + den) >= (n + k) * num
        fits = (F.col("comp_x") != F.col("comp_y")) & (F.least(n, k) * den >= F.greatest(n, k) * num) & reach
        rest = side(long.join(most, "key").where("comp <> most"), "x").join(side(long, "y"), "key").where(fits)
        return short.union(rest.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))).distinct()


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, limit: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id
    reachable over links of at least limit[0] / limit[1] Jaccard)."""
    C.ship(docs.sparkSession)
    bands = Bands(*limit)
    x = docs.select(C.key(id_col).alias("_k"), F.col(text_col).alias("_x"))
    base = C.stash(x.mapInArrow(_sketches(shingle, bands), "_k long, n long, d1 long, d2 long, small binary, home binary, visit binary, keys binary"), "parity")
    full = base.where("n > 0")
    about = full.groupBy("d1", "d2").agg(F.min("_k").alias("node"))
    # A node's sketches are its row's own: no sketch is shuffled to find the class's least id.
    nodes = full.join(about.withColumnRenamed("node", "_k"), ["d1", "d2", "_k"], "left_semi").withColumnRenamed("_k", "node").dropDuplicates(["node", "d1", "d2"])
    nodes = C.stash(nodes, "nodes")
    join = _Join(x, nodes, shingle, bands)
    links = join.links()
    # Rows of one id with several sets tie their classes together.
    both = F.struct("d1", "d2")
    repeated = full.groupBy("_k").agg(F.min(both).alias("lo"), F.max(both).alias("hi")).where("lo <> hi").select("_k")
    if repeated.limit(1).count():
        ties = full.join(repeated, "_k").select("_k", "d1", "d2").distinct().join(about, ["d1", "d2"])
        links = links.union(ties.select("_k", "node").mapInArrow(_contract(False), "hi long, lo long, many boolean").select("hi", "lo"))
    comps = join.search.components(links)
    named = about.join(comps, "node", "left").select("d1", "d2", F.coalesce("comp", "node").alias("comp"))
    out = full.select("_k", "n", "d1", "d2").join(named, ["d1", "d2"]).select("_k", "n", "comp")
    out = out.unionByName(base.where("n = 0").select("_k", "n", F.col("_k").alias("comp")))
    return out.select(C.id_of("_k").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("comp") != C.NO_ID, F.col("comp")).alias("component_id"))
