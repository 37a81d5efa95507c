"""Best-fit packing of documents into sequences by hierarchical residual packing.

Tasks encode the documents that they read and cut those longer than a sequence.  The
pieces, a few bytes each, are dealt to blocks of about `most_items` by a hash of their
place in the input: whatever the order of the corpus, by source or by length, each block
is a sample of all lengths.  A block packs its pieces best-fit, longest first.  Nearly
full bins (at most `slack` free places) are done.  Of the others the emptiest go on to the
next round, up to `2 * most_items / fan` items: a bin that is all but full as one item, what
a less full one holds as items of their own, since two halves glued to three quarters
would fit nothing.  The rest found nothing to be filled with among a sample of
everything, and are done.  In the next round `fan` neighbouring blocks meet in one: a tree
that ends in one block, each node of which holds twice `most_items` items at most, however large
the input.  No piece is ever left out.

Defined cases: a null or empty text is the closing token alone; repeated rows are
packed each on their own, and so are rows without an id; an id that is no number is
refused by the cast to long; a very long text is encoded whole by one task and cut;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: What a bin carries of a piece.
PIECE = np.dtype([("k", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("offset", "<i4")])
_PIECE = struct.Struct("<qiqiIi")  # the same
_ITEMS = "pos long, load int, members binary"
_OUT = "done boolean, bin long, load int, members binary, node int"
#: A bin that holds this share of a sequence goes on as one item.
_WHOLE = 0.995
_RUN = re.compile(r"\s{500}")


#: How a byte-level tokenizer of this kind cuts a text; fixed value.
_PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids as little-endian bytes.

    Where the merges' order is that of their ids, as in byte_bpe_50k.json, whole texts
    are encoded by tiktoken with the same vocabulary, which returns the same ids in a
    fraction of the time; texts with a special token, or with a run of white space that
    its regex engine could refuse, go to tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.fast = self._fast(json.load(open(path, encoding="utf-8")))

    @staticmethod
    def _fast(spec: dict):
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model["type"] != "BPE" or model.get("ignore_merges") or model.get("end_of_word_suffix"):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        import tiktoken

        added, byte_of = {t["content"] for t in spec["added_tokens"]}, _byte_of()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        return tiktoken.Encoding("texts", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or _RUN.search(text):
            return array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


def cut(n: int, most: int):
    """Pieces of n tokens: (start, length); only the first of several may be shorter."""
    head = n if n <= most else n % most
    if head:
        yield 0, head
    for s in range(head, n, most):
        yield s, most


def best_fit(loads: np.ndarray, most: int) -> tuple[list[list[int]], list[int]]:
    """Longest first into the fullest bin that has room: members and load of each."""
    bins: list[list[int]] = []
    full: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-loads, kind="stable").tolist():
        n = int(loads[i])
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
            bins[b].append(i)
            full[b] += n
        else:
            b = len(bins)
            bins.append([i])
            full.append(n)
        r = most - full[b]
        if r:
            by_room[r].append(b)
            rooms |= 1 << r
    return bins, full


def piece_row(k: int, piece: int, start: int, length: int, crc: int) -> bytes:
    return _PIECE.pack(k, piece, start, length, crc, 0)


def _glued(items: list[tuple[int, bytes]], of: list[int]) -> bytes:
    """The members of some items, one after the other."""
    if len(of) == 1:
        return items[of[0]][1]
    rows = np.frombuffer(b"".join([items[i][1] for i in of]), PIECE).copy()
    starts = np.cumsum([0, *[items[i][0] for i in of[:-1]]])
    rows["offset"] += np.repeat(starts, [len(items[i][1]) // PIECE.itemsize for i in of]).astype(np.int32)
    return rows.tobytes()


def _packed(items: list[tuple[int, bytes]], node: int, level: int, most: int, slack: int, hand_on: int):
    """A block's bins that are done, and the items that it hands on."""
    bins, full = best_fit(np.array([n for n, _ in items], np.int64), most)
    out = []  # done, load, members
    for b in sorted(range(len(bins)), key=full.__getitem__):
        own = bins[b]
        parts = 1 if full[b] >= _WHOLE * most else len(own)
        if full[b] < most - slack and parts <= hand_on:
            hand_on -= parts
            out += [(False, full[b], _glued(items, own))] if parts == 1 else [(False, *items[i]) for i in own]
        else:
            out.append((True, full[b], _glued(items, own)))
    number = (level << 56) + (node << 28)
    cols = [[r[0] for r in out], list(range(number, number + len(out))), [r[1] for r in out], [r[2] for r in out], [node] * len(out)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.int32()], strict=True)], names=["done", "bin", "load", "members", "node"])


def _pieces(path: str, end_id: int, most: int):
    """The pieces of each text, as items with a place in the input."""

    def run(batches):
        enc, end, pos = Encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for b in C.slices(batches):
            loads, members = [], []
            for k, text in zip(b.column("_k").to_pylist(), C.text_bytes(b.column("_x")), strict=True):
                ids = enc.encode(text.decode("utf-8")) + end
                for piece, (s, n) in enumerate(cut(len(ids) // 4, most)):
                    loads.append(n)
                    members.append(piece_row(k, piece, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            yield pa.RecordBatch.from_arrays([pa.array(range(pos, pos + len(loads)), pa.int64()), pa.array(loads, pa.int32()), pa.array(members, pa.binary())], names=["pos", "load", "members"])
            pos += len(loads)

    return run


def _round(level: int, most: int, slack: int, hand_on: int):
    """Rows come sorted by node."""

    def run(batches):
        node, items = None, []
        for b in batches:
            for at, load, members in zip(*[b.column(c).to_pylist() for c in ("node", "load", "members")], strict=True):
                if at != node and items:
                    yield _packed(items, node, level, most, slack, hand_on)
                    items = []
                node = at
                items.append((load, members))
        if items:
            yield _packed(items, node, level, most, slack, hand_on)

    return run


def _unpack(batches):
    for b in batches:
        rows = [np.frombuffer(m, PIECE) for m in b.column("members").to_pylist()]
        if not rows:
            continue
        seq = np.repeat(np.array(b.column("bin").to_pylist(), np.int64), [len(r) for r in rows])
        r = np.concatenate(rows)
        cols = [r["k"], r["piece"], r["start"], r["length"].astype(np.int64), r["crc"].astype(np.int64), seq, r["offset"].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["_k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, most: int = 1024, slack: int = 2, most_items: int = 50_000, fan: int = 4) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    C.ship(spark)
    x = docs.select(C.key(id_col).alias("_k"), F.col(text_col).alias("_x"))
    items = C.stash(x.mapInArrow(_pieces(path, end_id, most), _ITEMS), "pieces")
    nodes = max(1, -(-items.count() // most_items))
    left, done, level = items.withColumn("node", F.pmod(F.xxhash64("pos"), F.lit(nodes)).cast("int")), [], 0
    while True:
        hand_on = 0 if nodes == 1 else 2 * most_items // fan
        dealt = left.select("node", "load", "members").repartition(min(nodes, C.n_parts(spark)), "node").sortWithinPartitions("node", "load", "members")
        bins = C.stash(dealt.mapInArrow(_round(level, most, slack, hand_on), _OUT), "bins")
        done.append(bins.where("done"))
        if nodes == 1:
            break
        # Neighbours meet in one node of the next level.
        nodes, level = -(-nodes // fan), level + 1
        left = bins.where("NOT done").withColumn("node", F.floor(F.col("node") / fan).cast("int"))
    all_bins = done[0]
    for d in done[1:]:
        all_bins = all_bins.unionByName(d)
    out = all_bins.select("bin", "members").mapInArrow(_unpack, "_k long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(C.id_of("_k").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
