"""What both jobs share: settings, the command line, texts as files, the log."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

log = logging.getLogger("jobs")
#: Where a text belongs that names no source.
NO_SOURCE = "unknown"


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON file of settings, read by Spark: the path may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def as_files(texts: DataFrame) -> DataFrame:
    """Texts as files of repositories: a text's source is the repository, its id the file.
    A null text is empty; a text without a source belongs to `unknown`; other columns are
    left out."""
    repo = F.coalesce(F.nullif(F.col("source").cast("string"), F.lit("")), F.lit(NO_SOURCE))
    path = F.concat(repo, F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(".md"))
    return texts.select(repo.alias("job_id"), F.col("doc_id").cast("long").alias("file_seq"), path.alias("path"), F.lit("markdown").alias("language"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("source"))


def main(name: str, description: str, run: Callable[..., dict], paths: dict[str, str]) -> None:
    """The command line: the paths, then the settings file; the session lives as long."""
    p = argparse.ArgumentParser(prog=name, description=description)
    for path, text in paths.items():
        p.add_argument(f"--{path}", required=True, help=text)
    p.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), help="a JSON file of settings")
    args = vars(p.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = args.pop("config")
        run(spark, **args, **settings(spark, config if "://" in config else f"file://{os.path.abspath(config)}"))
    finally:
        spark.stop()
