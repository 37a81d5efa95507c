"""Sizes, languages and the folder tree of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def totals(files: DataFrame) -> DataFrame:
    return files.groupBy("job_id").agg(F.count("*").alias("total_files"), F.sum("loc").alias("total_loc"))


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("job_id", "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.min("file_seq").alias("first_seq"))


def primary_language(files: DataFrame) -> DataFrame:
    """The code language with the most lines; of equals, the first seen."""
    x = languages(files).where(~F.col("language").isin(*V.NOT_CODE))
    return x.groupBy("job_id").agg(F.max_by("language", F.struct("loc", -F.col("first_seq"))).alias("primary_language"))


def summary(files: DataFrame, ecosystem: DataFrame) -> DataFrame:
    l = languages(files).groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", F.struct("files", "loc"))))).alias("languages"))
    none = F.array().cast("array<string>")
    x = totals(files).join(l, "job_id").join(primary_language(files), "job_id", "left").join(ecosystem, "job_id", "left")
    return x.select("job_id", "total_files", "total_loc", "languages", "primary_language", F.coalesce("frameworks", none).alias("frameworks"), F.coalesce("package_managers", none).alias("package_managers"))


def folders(files: DataFrame) -> DataFrame:
    """job_id, path, name, parent_path, file_count, loc, primary_language of the root
    (path '') and every directory: each file counts for all of its ancestors.

    primary_language is that of most files; of equals, the first seen."""
    d = T.dirs("path")
    ups = F.transform(F.sequence(F.lit(0), F.size(d)), lambda n: F.array_join(F.slice(d, F.lit(1), n), "/"))
    x = files.select("job_id", "language", "loc", "file_seq", F.explode(ups).alias("folder"))
    by_lang = x.groupBy("job_id", "folder", "language").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"), F.min("file_seq").alias("first"))
    y = by_lang.groupBy("job_id", F.col("folder").alias("path")).agg(F.sum("n").alias("file_count"), F.sum("loc").alias("loc"), F.max_by("language", F.struct("n", -F.col("first"))).alias("primary_language"))
    return y.select("job_id", "path", T.basename("path").alias("name"), F.when(F.col("path") != "", F.array_join(T.dirs("path"), "/")).alias("parent_path"), "file_count", "loc", "primary_language")


def tree_rows(files: DataFrame) -> DataFrame:
    """Folders and files, numbered in the tree's order: directories first, then by name,
    depth first.  The order is that of one string key per row."""
    fo = folders(files).select("job_id", "path", "name", "parent_path", F.lit("dir").alias("type"), "file_count", "loc", F.col("primary_language").alias("language"))
    fi = files.select("job_id", "path", T.basename("path").alias("name"), F.array_join(T.dirs("path"), "/").alias("parent_path"), F.lit("file").alias("type"), F.lit(None).cast("long").alias("file_count"), F.col("loc").cast("long").alias("loc"), "language")
    x = fo.unionByName(fi)
    p = F.split("path", "/")
    n = F.size(p)
    key = F.when(F.col("path") == "", F.lit("")).otherwise(F.array_join(F.transform(p, lambda s, i: F.concat(F.when((i == n - 1) & (F.col("type") == "file"), "\x03").otherwise("\x02"), s)), "\x01"))
    return x.withColumn("position", F.row_number().over(W.partitionBy("job_id").orderBy(key)))


def nest(rows: list) -> dict:
    """The tree as nested dictionaries, of tree_rows() of one job in order."""
    at: dict[str, dict] = {}
    root = None
    for r in sorted(rows, key=lambda r: r["position"]):
        if r["type"] == "dir":
            node = {"name": r["name"], "path": r["path"], "type": "dir", "file_count": r["file_count"], "loc": r["loc"], "primary_language": r["language"], "children": []}
            at[r["path"]] = node
        else:
            node = {"name": r["name"], "path": r["path"], "type": "file", "language": r["language"], "loc": r["loc"]}
        if r["path"] == "" and r["type"] == "dir":
            root = node
        else:
            at[r["parent_path"]]["children"].append(node)
    return root or {"name": "", "path": "", "type": "dir", "file_count": 0, "loc": 0, "primary_language": None, "children": []}
