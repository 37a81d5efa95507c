"""Language identification in two steps.

A first set of linear classifiers picks the language family; within a family of
several languages, one-versus-one linear support vector machines separate them,
each pair by its own, and the votes decide.  Features are counts of byte one- to
three-grams of the text, with A-Z lower-cased, white space run together and digits
and punctuation left out, hashed to `dims` places, rooted and scaled to length one.

The model is fitted on the driver with a bounded sample of labelled rows: at most
`per_lang` rows of each language, those with the smallest hash of id and text, and at most
`most_rows` in all, in equal shares; every language that occurs is learned (the bounds are
these parameters; the executors keep them, also where many rows have one hash because they
are the same row).  More languages than `most_rows` are an error.  Everything else runs over
whole texts, without a shuffle.

Defined cases: a text that is null or has no letter is `und` with score 0; rows
without a language are not learned from; if no row can be learned from, all texts
are `und`; a null id is in fold 0, so it is not held out; a very long text is read
whole, a megabyte at a time; repeated rows repeat; other columns go through unchanged,
but for `lang_pred` and `score`, which are replaced; an id may be of any type that casts
to a string; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "sk"),
}
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def features(text: bytes, dims: int) -> np.ndarray:
    """Counts of grams over the whole text, in pieces of bounded size."""
    total = np.zeros(dims, np.float64)
    for at in range(0, max(1, len(text)), 1 << 20):
        b = _FOLD[np.frombuffer(text[max(0, at - 2) : at + (1 << 20)], np.uint8)]
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))] if len(b) else b
        x = b.astype(np.uint32)
        if len(x) > 2:
            g = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
            for h in (g, g >> 8, (g >> 16)):
                total += np.bincount(((h * np.uint32(2654435761)) >> np.uint32(16)) % dims, minlength=dims)
        elif len(x):
            total += np.bincount(((x * np.uint32(2654435761)) >> np.uint32(16)) % dims, minlength=dims)
    v = np.sqrt(total).astype(np.float32)
    n = np.linalg.norm(v)
    return v / n if n else v


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and bool(_LETTER.search(text.decode("utf-8", "replace"))))


def svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, epochs: int = 12, penalty: float = 1e-4, seed: int = 7) -> np.ndarray:
    """A linear support vector machine (hinge loss, mini-batch subgradient steps,
    averaged over the second half) of some rows of x; weights, then the bias."""
    rng = np.random.default_rng(seed)
    rows = np.arange(len(y)) if rows is None else rows
    w, mean, n, t = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0, 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for e in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 32):
            j = order[i : i + 32]
            t += 1
            bad = j[y[j] * (x[rows[j]] @ w[:-1] + w[-1]) < 1]
            step = 1 / (penalty * (t + 1000))
            w[:-1] *= 1 - step * penalty
            if len(bad):
                g = y[bad] * weight[bad]
                w[:-1] += step * (g @ x[rows[bad]]) / len(j)
                w[-1] += 0.1 * step * g.sum() / len(j)
            if e >= epochs // 2:
                mean, n = mean + w, n + 1
    return (mean / max(1, n)).astype(np.float32)


@dataclass
class Model:
    dims: int
    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None  # one row a family
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)
    scale: float = 3.0

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return "und", 0.0
        f, sure = 0, 1.0
        if len(self.families) > 1:
            m = self.family_w[:, :-1] @ v + self.family_w[:, -1]
            f = int(m.argmax())
            sure = 1 / (1 + float(np.exp(-self.scale * (m[f] - np.delete(m, f).max()))))
        langs = self.languages[self.families[f]]
        if len(langs) == 1:
            return langs[0], sure
        votes, margin = np.zeros(len(langs)), np.zeros(len(langs))
        for a, b, w in self.pairs[self.families[f]]:
            m = float(w[:-1] @ v + w[-1])
            votes[a if m > 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        best = int(np.lexsort((margin, votes))[-1])
        return langs[best], sure / (1 + float(np.exp(-self.scale * margin[best] / (len(langs) - 1))))


def family_of(lang: str, families=FAMILIES) -> str:
    return next((f for f, ls in families.items() if lang in ls), f"only {lang}")


def fit(x: np.ndarray, y: list[str], families=FAMILIES) -> Model:
    m = Model(x.shape[1])
    fam = np.array([family_of(l, families) for l in y])
    lang = np.array(y)
    m.families = sorted(set(fam))
    if len(m.families) == 2:
        w = svm(x, np.where(fam == m.families[0], 1, -1))
        m.family_w = np.stack([w / 2, -w / 2])
    elif m.families:
        m.family_w = np.stack([svm(x, np.where(fam == f, 1, -1)) for f in m.families])
    for f in m.families:
        m.languages[f] = ls = sorted(set(lang[fam == f]))
        m.pairs[f] = [(i, j, svm(x, np.where(lang[p] == a, 1, -1), p)) for i, a in enumerate(ls) for j, b in enumerate(ls) if i < j for p in [np.flatnonzero((lang == a) | (lang == b))]]
    return m


def train(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 800, most_rows: int = 51_200, dims: int = 4096, families=FAMILIES) -> Model:
    """Fit on at most `per_lang` rows, chosen by hash of id and text, of each language: at
    most `most_rows` sparse vectors come to the driver, however many rows, labels or copies
    of a row there are."""
    C.ship(docs.sparkSession)
    x = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    x = x.select(F.col(lang_col).cast("string").alias("l"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("x"))
    counts = x.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).limit(most_rows + 1).collect()
    if not counts:
        return Model(dims)
    if len(counts) > most_rows:
        raise ValueError(f"more than {most_rows} languages: raise most_rows")
    per_lang = min(per_lang, most_rows // len(counts))
    # About one and a half times the bound by distinct hashes, as copies of a row come or
    # stay away together; then exactly the smallest: each task keeps its own `per_lang`
    # smallest before any is shuffled.
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["l"], int(min(1.0, (1.5 * per_lang + 50) / r["d"]) * (1 << 30)))])
    chosen = x.where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, "l"))

    def run(batches):
        for b in C.slices(batches):
            vs = [zlib.compress(features(t, dims).astype(np.float16).tobytes(), 1) for t in C.text_bytes(b.column("x"))]
            yield pa.RecordBatch.from_arrays([b.column("l"), b.column("h"), pa.array(vs, pa.binary())], names=["l", "h", "v"])

    place = F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "v"))
    kept = chosen.mapInArrow(run, "l string, h long, v binary").withColumn("place", place).where(F.col("place") <= per_lang)
    rows = sorted(kept.select("l", "place", "v").collect(), key=lambda r: (r["l"], r["place"]))
    if not rows:
        return Model(dims)
    v = np.empty((len(rows), dims), np.float32)
    for i, r in enumerate(rows):
        v[i] = np.frombuffer(zlib.decompress(r["v"]), np.float16)
    return fit(v, [r["l"] for r in rows], families)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added, or replaced."""
    spark, docs = docs.sparkSession, docs.drop("lang_pred", "score")
    C.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # dims x (families + pairs) numbers
    cols = docs.columns
    t = cols.index(text_col)

    def run(batches):
        m = shared.value
        for b in C.slices(batches):
            made = [m.predict(features(x, m.dims)) if has_letter(x) else ("und", 0.0) for x in C.text_bytes(b.column(t))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p for p, _ in made], pa.string()), pa.array([s for _, s in made], pa.float64())], names=[*[f"c{i}" for i in range(len(cols))], "lang_pred", "score"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = docs.toDF(*[f"c{i}" for i in range(len(cols))]).mapInArrow(run, f"{schema}, lang_pred string, score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], "lang_pred", "score")


def fold(id_col: str = "doc_id") -> Column:
    """Of a null id 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)), F.lit(0).cast("long"))


def crc_fold(i: int) -> int:
    return zlib.crc32(str(i).encode()) % 4
