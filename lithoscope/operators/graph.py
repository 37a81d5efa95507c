"""The knowledge graph of a repository as two tables, nodes and edges."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udf import pandas_function
from .parsing import Code

_TRIES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def package_root(raw: Column) -> Column:
    """The external package that an import names."""
    clean = F.regexp_replace(raw, r"^[./ ]+|[./ ]+$", "")
    first = F.element_at(F.split(clean, "/"), 1)
    scoped = first.startswith("@") & clean.contains("/")
    plain = F.when(first.contains(".") & ~clean.contains("/"), F.element_at(F.split(first, r"\."), 1)).otherwise(first)
    return F.when(clean == "", raw).when(scoped, F.array_join(F.slice(F.split(clean, "/"), 1, 2), "/")).otherwise(plain)


@pandas_function("string")
def joined_path(path: pd.Series, raw: pd.Series) -> pd.Series:
    """An import relative to a file's directory, with `.` and `..` resolved; null for a null one."""
    return pd.Series([None if r is None else posixpath.normpath(posixpath.join(posixpath.dirname(p), r)) for p, r in zip(path, raw, strict=True)])


def unique_by(df: DataFrame, name: Column, node: Column) -> DataFrame:
    """job_id, short, target for names that exactly one row bears."""
    return df.groupBy("job_id", name.alias("short")).agg(F.count("*").alias("n"), F.first(node).alias("target")).where("n = 1").drop("n")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with `target`: a file's path, or null.

    A relative import tries eight names in order: every file says which bases it may be
    meant by, at most three, so that imports are not repeated for what they try.  Failing
    that, any import goes to the only file whose stem is its last segment."""
    names = F.array(*[F.lit(t) for t in _TRIES])
    meant = F.filter(F.transform(names, lambda t, i: F.when(F.endswith("path", t), F.struct(i.alias("prio"), F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(t)).alias("base")))), lambda s: s.isNotNull())
    exact = files.select("job_id", F.explode(meant).alias("m")).groupBy("job_id", F.col("m.base").alias("_base")).agg(F.min("m.prio").alias("_prio"))
    # What is no relative import has a base of its own, which no file can have: nulls would meet in one task.
    base = F.coalesce(joined_path("path", F.when(F.col("raw").startswith("."), F.col("raw"))), F.concat(F.lit("\0"), "path", F.lit("\0"), "imp_seq"))
    stem = F.lower(F.regexp_replace(T.basename("path"), r"(?<=.)(?<!^)\.[^.]*$", ""))
    by_stem = unique_by(files, stem, F.col("path")).withColumnRenamed("target", "_by_stem")
    last = F.lower(F.element_at(F.split(F.element_at(F.split(F.replace("raw", F.lit("\\"), F.lit("/")), "/"), -1), r"\."), -1))
    # Files are often exploded from few bytes, and Spark keeps to a broadcast that it chose by estimated size.
    x = imports.withColumn("short", last).withColumn("_base", base).join(exact.hint("merge"), ["job_id", "_base"], "left").join(by_stem.hint("merge"), ["job_id", "short"], "left")
    return x.select(*imports.columns, F.coalesce(F.concat("_base", F.get(names, F.col("_prio"))), "_by_stem").alias("target"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    x = resolve_imports(imports, files)
    return x.select("job_id", F.col("path").alias("source"), F.coalesce("target", F.concat(F.lit("external::"), package_root(F.col("raw")))).alias("target"), F.lit("imports").alias("type"), "raw", "file_seq", F.col("imp_seq").alias("seq"))


def name_edges(callers: DataFrame, names: str, targets: DataFrame, kind: str) -> DataFrame:
    """An edge for each name in an array of each row that one target alone bears, itself
    left out; a name given twice makes two edges."""
    x = callers.select("job_id", "file_seq", "sym_seq", "id", F.posexplode(names).alias("pos", "_n")).withColumn("short", T.last_part(F.col("_n")))
    x = x.join(targets, ["job_id", "short"]).where("target <> id")
    return x.select("job_id", F.col("id").alias("source"), "target", F.lit(kind).alias("type"), F.lit(None).cast("string").alias("raw"), "file_seq", (F.col("sym_seq") * 1000 + F.col("pos")).alias("seq"))


def with_ids(code: Code) -> tuple[DataFrame, DataFrame]:
    classes = code.classes.withColumn("id", T.symbol_id("path", "name"))
    functions = code.functions.withColumn("id", T.symbol_id("path", "name", "parent_class"))
    return classes, functions


def inherits_edges(classes: DataFrame) -> DataFrame:
    return name_edges(classes, "base_classes", unique_by(classes, F.col("name"), F.col("id")), "inherits")


def calls_edges(functions: DataFrame) -> DataFrame:
    return name_edges(functions, "calls", unique_by(functions, F.col("name"), F.col("id")), "calls")


def defines_edges(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """File to class, file to function, class to method where the class is known."""
    cols = ["job_id", "source", "target", F.lit("defines").alias("type"), F.lit(None).cast("string").alias("raw"), "file_seq", "seq"]
    a = classes.select("job_id", F.col("path").alias("source"), F.col("id").alias("target"), "file_seq", F.col("sym_seq").alias("seq"))
    top = F.col("parent_class").isNull() | (F.col("parent_class") == "")
    f = functions.select("job_id", F.when(top, F.col("path")).otherwise(T.symbol_id("path", "parent_class")).alias("source"), F.col("id").alias("target"), "file_seq", F.col("sym_seq").alias("seq"), top.alias("_top"))
    owners = classes.select("job_id", F.col("id").alias("source")).distinct()
    m = f.where("NOT _top").join(owners, ["job_id", "source"], "left_semi")
    return a.select(*cols).unionByName(f.where("_top").select(*cols)).unionByName(m.select(*cols))


def edges(code: Code) -> DataFrame:
    """job_id, source, target, type, raw, file_seq, seq; parallel edges and loops stay."""
    classes, functions = with_ids(code)
    x = defines_edges(classes, functions).unionByName(import_edges(code.imports, code.files))
    return x.unionByName(inherits_edges(classes)).unionByName(calls_edges(functions))


_ATTRIBUTES = ("type", "name", "file", "language", "start_line", "end_line", "loc", "complexity", "decorators", "base_classes", "parent_class", "num_classes", "num_functions", "parse_error")


def nodes(code: Code) -> DataFrame:
    """job_id, id and attributes.  Of nodes that share an id the later wins, attribute
    by attribute."""
    classes, functions = with_ids(code)
    loc = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1)).alias("loc")
    f = code.files.select("job_id", F.col("path").alias("id"), F.lit("file").alias("type"), "language", "loc", "num_classes", "num_functions", "parse_error", "file_seq", F.lit(-1).alias("seq"))
    c = classes.select("job_id", "id", F.lit("class").alias("type"), "name", F.col("path").alias("file"), "language", "start_line", "end_line", loc, "decorators", "base_classes", "file_seq", F.col("sym_seq").alias("seq"))
    top = F.col("parent_class").isNull() | (F.col("parent_class") == "")
    # A file's classes come before its functions.
    m = functions.select("job_id", "id", F.when(top, "function").otherwise("method").alias("type"), "name", F.col("path").alias("file"), "language", "start_line", "end_line", loc, "complexity", "decorators", "parent_class", "file_seq", (F.col("sym_seq") + 1_000_000).alias("seq"))
    imports = import_edges(code.imports, code.files).where(F.col("target").startswith("external::"))
    e = imports.select("job_id", F.col("target").alias("id"), F.lit("external_package").alias("type"), F.substring("target", 11, 10_000).alias("name"), F.lit((1 << 62)).alias("file_seq"), F.lit(0).alias("seq"))
    x = f.unionByName(c, allowMissingColumns=True).unionByName(m, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)
    at = F.struct("file_seq", "seq")
    merged = [F.max_by(F.col(a), F.when(F.col(a).isNotNull(), at)).alias(a) for a in _ATTRIBUTES]
    return x.groupBy("job_id", "id").agg(F.min(at).alias("first"), *merged)


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a job: the graph as JSON, an array of nodes and one of edges."""
    n = nodes.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("first", F.to_json(F.struct("id", *_ATTRIBUTES)).alias("j")))).alias("n"))
    e = edges.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("file_seq", "seq", "type", F.to_json(F.struct("source", "target", "type", "raw")).alias("j")))).alias("e"))
    js = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x["j"]), ","), F.lit("]"))
    return n.join(e, "job_id", "left").select("job_id", F.concat(F.lit('{"nodes":'), js("n"), F.lit(',"edges":'), F.coalesce(js("e"), F.lit("[]")), F.lit("}")).alias("graph"))


def from_json(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of to_json(), without the order columns."""
    node = "struct<id:string,type:string,name:string,file:string,language:string,start_line:int,end_line:int,loc:int,complexity:int,decorators:array<string>,base_classes:array<string>,parent_class:string,num_classes:int,num_functions:int,parse_error:string>"
    edge = "struct<source:string,target:string,type:string,raw:string>"
    x = graphs.select("job_id", F.from_json("graph", f"nodes array<{node}>, edges array<{edge}>").alias("g"))
    return tuple(x.select("job_id", F.explode(f"g.{c}").alias("x")).select("job_id", "x.*") for c in ("nodes", "edges"))
