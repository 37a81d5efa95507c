"""Secret scan with corpus-wide ownership frequency.

Every text is searched for credentials in three fixed shapes and, with a wider
net, for any long mixed token.  The values found are hashed, and each hash is
counted over the whole corpus by distinct repositories and distinct owners.  A
value that many owners hold, or very many repositories of whatever owners, is a
widely copied example; one that a single owner holds in fewer, and that looks random,
is live-looking.  The wider net adds a span only where its value is not widely copied.

The scan writes a table in which every row has a number of its own; what is found
later comes back by that number, and only to rows that hold a candidate, so neither
ids that are null or repeat nor copies of a row meet in one place.

Defined cases: a null text is empty and has no spans; null owners are one owner, the
same as one of an empty name, and so are null repositories; rows with equal id and text each get the same result; ids may be of any
type that casts to long; a very long text is scanned whole, in one task; an empty
table gives an empty result; other columns are ignored by the scan, whatever their
names, and go through `redact` unchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the longest run from the first AKIA, if of 20 or more
_HEX = re.compile(r"[0-9a-f]{24,}")
_WIDE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)

_SPAN = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
_MADE = [
    *[(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")], ("base_sha256", pa.string()), ("base", pa.list_(pa.struct(_SPAN))),
    ("found", pa.list_(pa.struct([*_SPAN, ("hash", pa.binary()), ("live", pa.bool_())]))),
]
_DDL = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,kind:int,end:int,hash:binary,live:boolean>>"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def looks_live(value: str, least_bits: float) -> bool:
    """Random enough: no word or placeholder such as xxxxxx or 123456."""
    return len(value) >= 12 and bool(_MIXED.match(value)) and entropy(value) >= least_bits


def apart(spans: list[tuple], base: list[tuple]):
    """The spans that overlap none of base, in one pass; both come by start, and the spans
    do not overlap each other."""
    i, reach = 0, 0
    for w in spans:
        while i < len(base) and base[i][0] < w[2]:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= w[0]:
            yield w


def find(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """Base spans and further candidates: (start, kind, end, value) by start, kind."""
    base = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    wide = [(m.start(), 3, m.end(), m[0]) for m in _WIDE.finditer(text)]
    if wide:  # access keys and long hex are inside such runs
        base += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
        base += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
        base.sort()
        wide = [w for w in apart(wide, base) if _MIXED.match(w[3])]
    return base, wide


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def _scan(text: int, keep: int, least_bits: float):
    """Adds what is found in column `text` to the first `keep` columns."""

    def run(batches):
        for b in C.slices(batches):
            out = []
            for t in C.text_bytes(b.column(text)):
                base, wide = find(t.decode("utf-8", "replace"))
                n = Counter(x[1] for x in base)
                found = [{"start": s, "kind": kd, "end": e, "hash": hashlib.sha256(v.encode()).digest(), "live": looks_live(v, least_bits)} for s, kd, e, v in base + wide]
                out.append({"n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "base": [{"start": s, "kind": kd, "end": e} for s, kd, e, _ in base], "found": found})
            made = pa.RecordBatch.from_pylist(out, schema=pa.schema(_MADE))
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], *made.columns], names=[*b.schema.names[:keep], *made.schema.names])

    return run


def _candidates(scanned: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """_row, start, kind, end, class, owners, repos of every span that counts."""
    occ = scanned.where(F.size("found") > 0).select("_row", "owner", "repo", F.explode("found").alias("f")).select("_row", "owner", "repo", "f.*")
    freq = C.stash(ownership(occ), "owners")
    # A value that many rows hold meets one row: Spark splits such a join.
    seen = occ.select("_row", "start", "kind", "end", "hash", "live").join(freq.select("hash", "owners", "repos"), "hash")
    kind = F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), "example").when((F.col("owners") == 1) & F.col("live"), "live").otherwise("shared")
    seen = seen.withColumn("class", kind).where((F.col("kind") < 3) | (F.col("live") & (F.col("class") != "example")))
    return seen.select("_row", "start", "kind", "end", "class", "owners", "repos")


def _named(owner_col: str, repo_col: str) -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((owner_col, "owner"), (repo_col, "repo"))]


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owner, repo) rows to one row a hash: distinct owners, distinct
    repositories, and how many rows.  Each step combines before it shuffles."""
    rows = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    per_owner = rows.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = 5, example_repos: int = 1000, least_bits: float = 3.0) -> DataFrame:
    """One row per row of docs: `id_col`, n_assign, n_access, n_hex, base_sha256,
    spans (array of start, kind, end, class, owners, repos) and n_live, n_shared, n_example.

    class: `example` if `example_owners` or more distinct owners or `example_repos` or
    more distinct repositories hold the value, `live` if one owner holds it and it looks
    random, else `shared`; owners and repos are how many hold it."""
    C.ship(docs.sparkSession)
    src = docs.select(F.monotonically_increasing_id().alias("_row"), C.key(id_col).alias("_k"), *_named(owner_col, repo_col), F.col(text_col).alias("_x"))
    scanned = C.stash(src.mapInArrow(_scan(4, 4, least_bits), f"_row long, _k long, owner string, repo string, {_DDL}"), "secrets")  # without texts: a small table
    per_row = _candidates(scanned, example_owners, example_repos).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "class", "owners", "repos"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,class:string,owners:bigint,repos:bigint>>")
    some = scanned.where(F.size("found") > 0).join(per_row, "_row", "left").withColumn("spans", F.coalesce("spans", none))
    out = some.unionByName(scanned.where(F.size("found") == 0).withColumn("spans", none))
    n = lambda c: F.size(F.filter("spans", lambda s: s["class"] == c)).cast("long").alias(f"n_{c}")
    return out.select(C.id_of("_k").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", n("live"), n("shared"), n("example"))


def span_text(spans: str) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "<SECRET>", example_owners: int = 5, example_repos: int = 1000, least_bits: float = 3.0) -> DataFrame:
    """docs with every span that is not a widely copied example replaced by
    `mark`; overlapping spans become one mark.  A null text stays null.

    The texts are written once, with what was found in them; only rows that hold a
    candidate are shuffled."""
    C.ship(docs.sparkSession)
    n, t = len(docs.columns), docs.columns.index(text_col)
    src = docs.select(F.monotonically_increasing_id().alias("_row"), *_named(owner_col, repo_col), *[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    scanned = C.stash(src.mapInArrow(_scan(3 + t, 3 + n, least_bits), f"_row long, owner string, repo string, {kinds}, {_DDL}"), "secrets")
    spans = _candidates(scanned, example_owners, example_repos).where("class <> 'example'").groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    cols = [f"c{i}" for i in range(n)]

    def run(batches):
        for b in C.slices(batches):
            new = [_cut(x, [(s["start"], s["end"]) for s in found], mark) for x, found in zip(b.column(t).to_pylist(), b.column(n).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == t else b.column(i) for i in range(n)], names=cols)

    held = scanned.where(F.size("found") > 0).select("_row", *cols).join(spans, "_row", "left")
    masked = held.where("_spans IS NOT NULL").select(*cols, "_spans").mapInArrow(run, kinds)
    out = masked.unionByName(held.where("_spans IS NULL").select(*cols)).unionByName(scanned.where(F.size("found") == 0).select(*cols))
    return out.toDF(*docs.columns)


def _cut(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])
