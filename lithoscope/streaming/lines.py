"""The line detectors over a stream of files: new files in a folder are scanned as they
come.  The detectors hold no state, so any sink and trigger will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings


def stream_files(spark: SparkSession, folder: str, job_id: str = "stream") -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    x = raw.where((F.col("length") > 0) & T.is_text(F.col("content")))
    return x.select(F.lit(job_id).alias("job_id"), F.xxhash64("path").alias("file_seq"), "path", T.language("path").alias("language"), T.decode(F.col("content")).alias("source"))


def stream_security(files: DataFrame) -> DataFrame:
    x = files.select("job_id", "file_seq", "path", "language", F.posexplode(T.lines("source")).alias("line", "text"))
    return findings.analyze_security(x.withColumn("line", F.col("line") + 1))
