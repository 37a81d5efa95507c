"""Job: audit of new texts for committed secrets and unsafe code, as they arrive.

    python jobs/audit_stream.py --texts DIR --output DIR --checkpoint DIR [--config FILE]

`texts` is a folder (or one file) of Parquet with the columns doc_id, source and text.  A
file stream takes the files that the checkpoint has not seen yet, in batches of
`files_per_batch`, and ends when there are none: start it by a timer.  Every text is a
file of the repository that its source names; its lines go through the library's
security detectors, and through one for quoted values that are assigned to any of
`secret_names`, names that only the user knows to be secret.  The output has two tables:

    findings  batch=N/severity=S: source, doc_id, line, seq, category, message
    scanned   batch=N: source, documents, lines

A batch writes its own partitions and replaces them if it runs again, so that a run that
was stopped midway and started again gives the same tables.  Without new files a run
changes nothing.

Defined cases: null texts have no lines but count as documents; null and empty sources
are `unknown`; rows that repeat are audited each; a very long text is split by the task
that reads it; other columns are ignored; an empty folder gives no batch.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs._common import as_files, log, main
from lithoscope.functions import text as T
from lithoscope.functions import values as V
from lithoscope.operators import findings

COLUMNS = "source string, doc_id long, line int, seq long, category string, message string, batch long, severity string"
SCANNED = "source string, documents long, lines long, batch long"


#: Names that are not secret by themselves, but here.
SECRET_NAMES = ("token", "client_secret")


def assigned(names: list[str] | tuple[str, ...]) -> str:
    """A pattern for quoted values of eight characters or more that names are set to."""
    if not all(re.fullmatch(r"\w+", n) for n in names):
        raise ValueError(f"names of letters, digits and underscores only: {names}")
    return rf"""\b({'|'.join(names)})\b\s*[:=]\s*["']([^"']{{8,}})["']"""


def named_secrets(lines: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """job_id, file_seq, line, seq, category, severity, message: assignments to `names`,
    but for placeholders and what stands with the environment."""
    pattern = F.lit(T.rx(assigned(names), True))
    x = lines.where(reduce(lambda a, b: a & b, [~F.contains("text", F.lit(h)) for h in V.ENV_HINTS]))
    hits = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("k"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("v"))
    x = x.select("job_id", "file_seq", "line", F.posexplode(hits).alias("i", "h"))
    v = F.col("h")["v"]
    x = x.where(~F.lower(v).isin(*V.PLACEHOLDERS) & ~v.startswith("${") & ~v.startswith("{{"))
    message = F.concat(F.lit("possible hardcoded "), F.col("h")["k"])
    return x.select("job_id", "file_seq", "line", (F.lit(1000) + F.col("i")).cast("long").alias("seq"), F.lit("named_secret").alias("category"), F.lit("critical").alias("severity"), message.alias("message"))


def suspicious(text: str, names: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether any detector could find something in a line: only such lines are kept for
    the detectors, each of which reads them once more."""
    plain = [V.AWS_KEY, V.PRIVATE_KEY, *V.SQL_INJECTION, *[p for p, _ in V.DESERIALIZATION]]
    folded = [V.SECRET, V.WEAK_HASH, V.SENSITIVE_LOG, *([assigned(names)] if names else [])]
    return reduce(lambda a, b: a | b, [*[T.has(text, p) for p in plain], *[T.has(text, p, True) for p in folded]])


def lines_of(files: DataFrame) -> DataFrame:
    x = files.select("job_id", "file_seq", "path", "language", F.posexplode(T.lines("source")).alias("line", "text"))
    return x.withColumn("line", F.col("line") + 1)


def only(path: str) -> str:
    """A pattern that nothing but this path fits: of a file, a stream takes no other name."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _write(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def audit(batch: DataFrame, number: int, output: str, severities: list[str], names: list[str] | tuple[str, ...] = ()) -> None:
    """One batch's partitions of both tables."""
    files = as_files(batch)
    kept = lines_of(files).where(suspicious("text", names)).persist()
    cols = ["job_id", "file_seq", "line", "seq", "category", "severity", "message"]
    found = findings.analyze_security(kept).select(*cols)
    if names:
        found = found.unionByName(named_secrets(kept, names))
    found = found.where(F.col("severity").isin(*severities)).select(F.col("job_id").alias("source"), F.col("file_seq").alias("doc_id"), "line", "seq", "category", "message", F.lit(number).cast("long").alias("batch"), "severity")
    _write(found.hint("rebalance", "severity"), f"{output}/findings", "batch", "severity")
    kept.unpersist()
    n = F.size(T.lines("source"))
    scanned = files.groupBy(F.col("job_id").alias("source")).agg(F.count("*").alias("documents"), F.sum(n).cast("long").alias("lines"))
    _write(scanned.withColumn("batch", F.lit(number).cast("long")).coalesce(1), f"{output}/scanned", "batch")


def run(spark: SparkSession, texts: str, output: str, checkpoint: str, files_per_batch: int = 64, severities: list[str] | tuple[str, ...] = V.SEVERITIES, secret_names: list[str] | tuple[str, ...] = SECRET_NAMES) -> dict:
    """Audits what is new; returns what was read and how many batches that took."""
    output = output.rstrip("/")
    stream = spark.readStream.schema("doc_id long, source string, text string").option("maxFilesPerTrigger", files_per_batch).parquet(only(texts))
    severities = list(severities)
    batches: list[int] = []

    def take(df: DataFrame, n: int) -> None:
        audit(df, n, output, severities, secret_names)
        batches.append(n)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = {"read": texts, "batches": len(batches), "wrote": output}
    if batches:
        rows = scanned(spark, output).where(F.col("batch").isin(batches)).agg(F.sum("documents").alias("d"), F.sum("lines").alias("l")).first()
        done |= {"documents": rows["d"], "lines": rows["l"], "findings": read(spark, output).where(F.col("batch").isin(batches)).count()}
    log.info("audit_stream %s", done)
    return done


def read(spark: SparkSession, output: str) -> DataFrame:
    """The findings of all batches."""
    return spark.read.schema(COLUMNS).parquet(f"{output.rstrip('/')}/findings")


def scanned(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCANNED).parquet(f"{output.rstrip('/')}/scanned")


if __name__ == "__main__":
    main("audit_stream", "Audit new texts for secrets and unsafe code.", run, {"texts": "Parquet with doc_id, source, text", "output": "folder of the tables", "checkpoint": "folder of the stream's progress"})
