"""Corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Each stage works on all rows the one before kept.  A stage reads `docs` more than
once, which is why run() writes what a stage returns and reads it again.  A table
needs `doc_id` and `text`; of the other columns of documents what is missing is null,
and further columns are dropped.  Ids may be null or repeat: where a stage needs to
tell rows apart, it makes keys of its own, so that no row is lost for its id.  A very
long text is one row of one task in every stage, read whole; of equal texts, and of
equally near ones, the smallest key stays, so that ties are decided alike on every run;
an empty table gives empty stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.llm import _common, exact_dedup, langid, minhash_dedup, packing, queries, secret_scan

#: Documents whose prediction scores less are rejected.  A score is the product of two
#: logistic values, of the family's margin and of the language's within it, and no probability.
LEAST_SCORE = 0.5
_TYPES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
COLUMNS = tuple(_TYPES)
#: Keys of rows without an id of their own are above those of all others.
_OWN = 1 << 62


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[docs[c] if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in _TYPES.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those it can't tell the language of; what
    it predicts for the others is their `lang` from here on."""
    docs = _columns(docs)
    model = langid.train(docs, langid.fold() != 2)
    out = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal without white space one stays, also of rows that
    repeat an id."""
    docs = _columns(docs)
    text = F.sha2(F.translate(F.coalesce("text", F.lit("")), _common.SPACE, ""), 256)
    v = exact_dedup.dedup_exact(docs).where("kept").select(_common.key("doc_id").alias("_k"), F.col("text_sha256").alias("_t"))
    docs = docs.select("*", _common.key("doc_id").alias("_k"), text.alias("_t"))
    repeated = docs.groupBy("_k", "_t").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    kept = docs.join(v, ["_k", "_t"], "left_semi")
    return (kept.dropDuplicates(["_k", "_t"]) if repeated else kept).select(*COLUMNS)


def row_keys(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column that tells rows with different texts apart: the id, but for
    rows without one or with one that repeats, whose key is made from the text."""
    own = F.lit(_OWN) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(_OWN))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return docs.withColumn(name, F.coalesce("doc_id", own))
    flagged = docs.join(repeated.withColumn("_repeats", F.lit(True)), "doc_id", "left")
    return flagged.withColumn(name, F.when(F.col("_repeats"), own).otherwise(F.coalesce("doc_id", own))).drop("_repeats").select(*docs.columns, name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays.  Five-word shingles, similarity of 0.8.  Rows of
    the same id and text are one document and stay or go together."""
    docs = row_keys(_columns(docs), "_row")
    v = minhash_dedup.near_duplicates(docs, id_col="_row", shingle=5, limit=(80, 100)).where("kept").select("_row").distinct()
    return docs.join(v, "_row", "left_semi").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; secrets that are not widely copied examples are masked."""
    out = secret_scan.redact(_columns(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_columns(docs), queries.tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Neither the classifier, nor similarity, nor best-fit packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _common.stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
