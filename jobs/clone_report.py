"""Job: passages that texts of one or several sources have copied from each other.

    python jobs/clone_report.py --texts DIR --output DIR [--config FILE]

`texts` is Parquet with the columns doc_id, source and text.  Every text is a file of the
repository that its source names.  A block is `block_lines` lines in a row, stripped of
white space at both ends, as the library's duplicate detector takes them; blocks that
`least_documents` texts hold are copies, and blocks of a text that overlap or touch are one
passage.  The output has two tables:

    passages  source=S: doc_id, start_line, end_line, holders, repositories, first_doc
    sources   source, documents, lines, copied_documents, copied_lines, borrowed_lines

holders and repositories are those of the passage's most widespread block, first_doc is
the smallest id that holds a block of it; lines of passages whose first_doc is another text
are borrowed.  Running again replaces both tables.

A block that very many texts hold is counted by text, then by repository, then in all, each
step combined before it is shuffled; its places meet one row of counts, a join that Spark
splits.  Passages are made within a text.

Defined cases: null texts have no lines; null and empty sources are `unknown`; rows that
repeat an id within a source are one text, of the lines of all of them; files in test
folders are left out, as the detector does; a very long text is one row of one task;
other columns are ignored; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

if __package__ in (None, ""):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs._common import as_files, log, main
from lithoscope.functions import text as T
from lithoscope.operators import findings

PASSAGES = "doc_id long, start_line int, end_line int, holders long, repositories long, first_doc long, source string"
SOURCES = "source string, documents long, lines long, copied_documents long, copied_lines long, borrowed_lines long"


def shared_blocks(blocks: DataFrame, least_documents: int) -> DataFrame:
    """digest, holders, repositories, first_doc of blocks that several texts hold."""
    texts = blocks.groupBy("digest", "job_id", "file_seq").agg(F.count("*").alias("places"))
    # All texts have places; but if their number were not read, the shuffle of the places would not be shared.
    repos = texts.groupBy("digest", "job_id").agg(F.count_if(F.col("places") > 0).alias("holders"), F.min("file_seq").alias("first_doc"))
    all_ = repos.groupBy("digest").agg(F.sum("holders").alias("holders"), F.count("*").alias("repositories"), F.min("first_doc").alias("first_doc"))
    return all_.where(F.col("holders") >= least_documents)


def passages(files: DataFrame, block_lines: int, least_documents: int) -> DataFrame:
    """Blocks that overlap or touch, as one row each."""
    # Counts and places read one shuffle of the places: texts are cut and hashed once.
    places = findings.blocks(files, block_lines).select("job_id", F.unhex("digest").alias("digest"), "file_seq", "line").distinct()
    x = places.join(shared_blocks(places, least_documents), "digest")
    text = W.partitionBy("job_id", "file_seq").orderBy("line")
    gap = F.col("line") > F.coalesce(F.lag("line").over(text), F.lit(-block_lines)) + block_lines
    x = x.withColumn("passage", F.sum(gap.cast("int")).over(text))
    g = x.groupBy("job_id", "file_seq", "passage").agg(F.min("line").alias("start_line"), (F.max("line") + block_lines - 1).alias("end_line"), F.max("holders").alias("holders"), F.max("repositories").alias("repositories"), F.min("first_doc").alias("first_doc"))
    return g.select(F.col("file_seq").alias("doc_id"), "start_line", "end_line", "holders", "repositories", "first_doc", F.col("job_id").alias("source"))


def by_source(files: DataFrame, made: DataFrame) -> DataFrame:
    n = F.col("end_line") - F.col("start_line") + 1
    copied = made.groupBy("source", "doc_id").agg(F.sum(n).alias("c"), F.sum(F.when(F.col("first_doc") != F.col("doc_id"), n).otherwise(0)).alias("b"))
    copied = copied.groupBy("source").agg(F.count("*").alias("copied_documents"), F.sum("c").alias("copied_lines"), F.sum("b").alias("borrowed_lines"))
    all_ = files.groupBy(F.col("job_id").alias("source")).agg(F.count("*").alias("documents"), F.sum(F.size(T.lines("source"))).cast("long").alias("lines"))
    return all_.join(copied, "source", "left").na.fill(0, ["copied_documents", "copied_lines", "borrowed_lines"])


def run(spark: SparkSession, texts: str, output: str, block_lines: int = 3, least_documents: int = 2) -> dict:
    """Writes both tables; returns what was read and written."""
    output = output.rstrip("/")
    files = as_files(spark.read.parquet(texts))
    made = passages(files, block_lines, least_documents)
    made.hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(f"{output}/passages")
    made = read(spark, output)
    by_source(files, made).coalesce(1).write.mode("overwrite").parquet(f"{output}/sources")
    rows = sources(spark, output).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("d"), F.coalesce(F.sum("lines"), F.lit(0)).alias("l"), F.count("*").alias("s")).first()
    done = {"read": texts, "documents": rows["d"], "lines": rows["l"], "wrote": output, "sources": rows["s"], "passages": made.count()}
    log.info("clone_report %s", done)
    return done


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(PASSAGES).parquet(f"{output.rstrip('/')}/passages")


def sources(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SOURCES).parquet(f"{output.rstrip('/')}/sources")


if __name__ == "__main__":
    main("clone_report", "Report passages that texts have copied from each other.", run, {"texts": "Parquet with doc_id, source, text", "output": "folder of the tables"})
