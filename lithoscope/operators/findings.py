"""Detectors of quality, security and performance: rows of
job_id, analyzer, category, severity, file, message, line, symbol, file_seq, seq."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .parsing import Code

COLUMNS = ("job_id", "analyzer", "category", "severity", "file", "message", "line", "symbol", "file_seq", "seq")


def _finding(df: DataFrame, analyzer: str, category: str, severity: str | Column, message: Column | str, line: str, symbol: str | None = None, seq: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        "job_id", F.lit(analyzer).alias("analyzer"), F.lit(category).alias("category"), lit(severity).alias("severity"), F.col("path").alias("file"), lit(message).alias("message"), F.col(line).cast("int").alias("line"),
        (F.col(symbol) if symbol else F.lit(None)).cast("string").alias("symbol"), "file_seq", (F.lit(0) if seq is None else seq).cast("long").alias("seq"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def by_severity(findings: DataFrame) -> DataFrame:
    """Numbered from critical to info, then in the order of files and lines."""
    w = W.partitionBy("job_id").orderBy(T.severity_rank("severity"), "file_seq", "file", "line", "seq", "category", "message")
    return findings.withColumn("position", F.row_number().over(w))


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("job_id", "analyzer", "category").agg(F.count("*").alias("n"))


def tab_counts(matches: DataFrame, violations: DataFrame, findings: DataFrame) -> DataFrame:
    """job_id, tab, n: how many rows each list of results has, in the order they are shown."""
    count = lambda df, tab: df.groupBy("job_id").agg(F.count("*").alias("n")).select("job_id", F.lit(tab).alias("tab"), "n")
    tabs = [count(matches, "patterns"), count(violations, "solid"), *[count(findings.where(F.col("analyzer") == a), a) for a in ("quality", "security", "performance")]]
    return _union(tabs)


def with_method_counts(code: Code) -> DataFrame:
    """Classes with the number, and the lower-case names, of their file's methods."""
    m = code.functions.where("parent_class IS NOT NULL").groupBy("job_id", "path", F.col("parent_class").alias("name")).agg(F.count("*").alias("methods"), F.collect_set(F.lower("name")).alias("method_names"))
    x = code.classes.join(m, ["job_id", "path", "name"], "left")
    return x.withColumn("methods", F.coalesce("methods", F.lit(0))).withColumn("method_names", F.coalesce("method_names", F.array().cast("array<string>")))


def _loc() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


# --- quality -----------------------------------------------------------------


def quality_metrics(functions: DataFrame) -> DataFrame:
    return functions.groupBy("job_id").agg(F.count("*").alias("total_functions"), F.coalesce(F.bround(F.avg("complexity"), 2), F.lit(0.0)).alias("average_complexity"), F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity"), F.count_if(F.col("complexity") > V.COMPLEX).alias("high_complexity_functions"))


def complex_functions(functions: DataFrame) -> DataFrame:
    very = F.col("complexity") > V.VERY_COMPLEX
    text = F.concat(F.lit("'"), F.col("name"), F.lit("' has cyclomatic complexity "), F.col("complexity").cast("string"), F.when(very, " (very high, consider decomposing)").otherwise(""))
    return _finding(functions.where(F.col("complexity") > V.COMPLEX), "quality", "high_complexity", F.when(very, "high").otherwise("medium"), text, "start_line", "name", F.col("sym_seq"))


def long_methods(functions: DataFrame) -> DataFrame:
    x = functions.withColumn("_n", _loc()).where(F.col("_n") > V.LONG_METHOD)
    return _finding(x, "quality", "long_method", "medium", F.format_string(f"'%s' is %d lines long (> {V.LONG_METHOD})", "name", "_n"), "start_line", "name", F.col("sym_seq"))


def deep_nesting(functions: DataFrame) -> DataFrame:
    x = functions.where(F.col("max_nesting_depth") > V.DEEP)
    return _finding(x, "quality", "deep_nesting", "medium", F.format_string(f"'%s' nests %d levels deep (> {V.DEEP})", "name", "max_nesting_depth"), "start_line", "name", F.col("sym_seq"))


def large_classes(counted: DataFrame) -> DataFrame:
    x = counted.withColumn("_n", _loc()).where(F.col("_n") > V.LARGE_CLASS)
    god = F.col("methods") > V.GOD_METHODS
    a = _finding(x.where(god), "quality", "god_class", "high", F.format_string("'%s' is a god class: %d lines, %d methods", "name", "_n", "methods"), "start_line", "name", F.col("sym_seq"))
    return a.unionByName(_finding(x.where(~god), "quality", "large_class", "medium", F.format_string(f"'%s' is %d lines long (> {V.LARGE_CLASS})", "name", "_n"), "start_line", "name", F.col("sym_seq")))


def magic_numbers(bodies: DataFrame, most: int = 5) -> DataFrame:
    """The first few numbers of each function that are not plain ones."""
    x = bodies.where("kind <> 'class'").select("job_id", "file_seq", "path", "sym_seq", "name", "start_line", F.posexplode("body").alias("_i", "text"))
    s = T.strip(F.col("text"))
    x = x.where((s != "") & ~F.startswith(s, F.lit("#")) & ~F.startswith(s, F.lit("//")) & ~F.startswith(s, F.lit("*")) & ~F.startswith(s, F.lit("/*")) & ~T.has("text", V.CONST_LINE))
    x = x.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(T.rx(V.NUMBER)), F.lit(1))).alias("_p", "number")).where(~F.col("number").isin(*V.PLAIN_NUMBERS))
    x = x.withColumn("_r", F.row_number().over(W.partitionBy("job_id", "path", "sym_seq").orderBy("_i", "_p"))).where(F.col("_r") <= most)
    x = x.withColumn("line", F.col("start_line") + F.col("_i"))
    return _finding(x, "quality", "magic_number", "low", F.format_string("magic number %s in '%s'", "number", "name"), "line", "name", F.col("sym_seq") * 10 + F.col("_r"))


def blocks(sources: DataFrame, lines: int = V.BLOCK_LINES) -> DataFrame:
    """job_id, digest, path, line of every window of `lines` stripped lines that is not
    trivial, outside tests.  Windows are slices of the file's own lines, made and hashed
    within its row: no shuffle, and no row has the file's lines beside a window."""
    def window(l, i):
        w = F.slice(l, i, lines)
        digest = T.let(F.array_join(w, "\n"), lambda t: F.when((F.length(t) >= 40) & (F.size(F.filter(w, lambda s: s != "")) >= lines - 1), F.sha1(t)))
        return F.struct(digest.alias("digest"), i.alias("line"))

    def windows(l):
        return F.when(F.size(l) >= lines, F.transform(F.sequence(F.lit(1), F.size(l) - (lines - 1)), lambda i: window(l, i)))

    stripped = T.let(F.split("source", T.LINE_END, -1), lambda a: F.transform(T.without_last(a), T.strip))
    x = sources.where(~T.is_test("path")).select("job_id", "file_seq", "path", F.explode(T.let(stripped, windows)).alias("b"))
    return x.where("b.digest IS NOT NULL").select("job_id", "b.digest", "file_seq", "path", "b.line")


def duplicate_blocks(sources: DataFrame, lines: int = V.BLOCK_LINES) -> DataFrame:
    """job_id, digest, n, first_seen, at: the first three places of each block that
    stands in two or more.  Places are pre-aggregated by file before the shuffle, and
    only three are kept, however many files share a block."""
    b = blocks(sources, lines)
    g = b.groupBy("job_id", "digest", "path").agg(F.count("*").alias("n"), F.min(F.struct("file_seq", "line")).alias("first"), F.slice(F.array_sort(F.collect_list("line")), 1, 3).alias("ls"))
    g = g.select("job_id", "digest", "n", "first", F.transform("ls", lambda l: F.struct(F.col("path").alias("file"), l.alias("line"))).alias("ps"))
    # Two steps by salt: no task gathers the places of a block that very many files share.
    salted = g.withColumn("s", F.pmod(F.xxhash64("ps"), F.lit(64)))
    cut = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, 3)
    once = salted.groupBy("job_id", "digest", "s").agg(F.sum("n").alias("n"), F.min("first").alias("first"), cut("ps").alias("ps"))
    out = once.groupBy("job_id", "digest").agg(F.sum("n").alias("n"), F.min("first").alias("first_seen"), cut("ps").alias("at"))
    return out.where("n > 1")


def duplicate_findings(sources: DataFrame, most: int = 50) -> DataFrame:
    """The first fifty blocks of each job, in the order in which they are seen."""
    d = duplicate_blocks(sources)
    d = d.withColumn("_r", F.row_number().over(W.partitionBy("job_id").orderBy("first_seen", "digest"))).where(F.col("_r") <= most)
    places = F.array_join(F.transform(F.slice("at", 2, 2), lambda p: F.concat(p["file"], F.lit(":"), p["line"].cast("string"))), ", ")
    text = F.concat(F.lit(f"{V.BLOCK_LINES}-line block duplicated at "), places, F.when(F.col("n") > 3, F.concat(F.lit(" and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise(""))
    x = d.select("job_id", F.get("at", F.lit(0))["file"].alias("path"), F.get("at", F.lit(0))["line"].alias("line"), text.alias("_t"), F.lit(1 << 61).alias("file_seq"), F.col("_r"))
    return _finding(x, "quality", "duplicate_code", "low", F.col("_t"), "line", None, F.col("_r"))


def dead_functions(functions: DataFrame, call_edges: DataFrame) -> DataFrame:
    """Top-level functions that no resolved call reaches.  functions have ids."""
    f = functions.where((F.col("kind") == "function") & ~T.is_test("path") & (F.coalesce(F.size("decorators"), F.lit(0)) == 0) & ~F.col("name").isin(*V.ENTRYPOINTS) & ~F.startswith("name", F.lit("test_")))
    called = call_edges.select("job_id", F.col("target").alias("id")).distinct()
    x = f.withColumn("id", T.symbol_id("path", "name")).join(called, ["job_id", "id"], "left_anti")
    return _finding(x, "quality", "dead_code", "low", F.concat(F.lit("'"), F.col("name"), F.lit("' has no resolved callers in this repo (may be dynamic, tests-only, or public API)")), "start_line", "name", F.lit(1 << 60) + F.col("sym_seq"))


def analyze_quality(code: Code, call_edges: DataFrame) -> DataFrame:
    f = code.functions
    return _union([complex_functions(f), long_methods(f), deep_nesting(f), large_classes(with_method_counts(code)), magic_numbers(code.bodies), duplicate_findings(code.sources), dead_functions(f, call_edges)])


# --- security ----------------------------------------------------------------


def secrets(lines: DataFrame) -> DataFrame:
    x = lines.where(reduce(lambda a, b: a & b, [~F.contains("text", F.lit(h)) for h in V.ENV_HINTS]))
    hits = F.arrays_zip(F.regexp_extract_all("text", F.lit(T.rx(V.SECRET, True)), F.lit(1)).alias("k"), F.regexp_extract_all("text", F.lit(T.rx(V.SECRET, True)), F.lit(2)).alias("v"))
    a = x.where(T.has("text", V.SECRET, True)).select("*", F.posexplode(hits).alias("_i", "h"))
    v = F.col("h")["v"]
    a = a.where(~F.lower(v).isin(*V.PLACEHOLDERS) & ~v.startswith("${") & ~v.startswith("{{"))
    out = [_finding(a, "security", "hardcoded_secret", "critical", F.concat(F.lit("possible hardcoded "), F.col("h")["k"]), "line", None, F.col("_i"))]
    out.append(_finding(x.where(T.has("text", V.AWS_KEY)), "security", "hardcoded_secret", "critical", "AWS access key ID literal found", "line", None, F.lit(900)))
    out.append(_finding(x.where(T.has("text", V.PRIVATE_KEY)), "security", "hardcoded_secret", "critical", "private key material committed to source", "line", None, F.lit(901)))
    return _union(out)


def sql_injection(lines: DataFrame) -> DataFrame:
    x = lines.where(reduce(lambda a, b: a | b, [T.has("text", p) for p in V.SQL_INJECTION]))
    return _finding(x, "security", "sql_injection", "high", "user input may be interpolated directly into a SQL query — use parameterized queries", "line", None, F.lit(910))


def unsafe_deserialization(lines: DataFrame) -> DataFrame:
    why = F.coalesce(*[F.when(T.has("text", p), F.lit(r)) for p, r in V.DESERIALIZATION])
    return _finding(lines.withColumn("_w", why).where("_w IS NOT NULL"), "security", "unsafe_deserialization", "high", F.col("_w"), "line", None, F.lit(920))


def weak_auth(lines: DataFrame) -> DataFrame:
    x = lines.where(T.has("text", V.WEAK_HASH, True) & F.lower("text").contains("password"))
    return _finding(x, "security", "weak_auth", "high", "MD5/SHA1 is not suitable for password hashing — use bcrypt/argon2/scrypt", "line", None, F.lit(930))


def sensitive_logs(lines: DataFrame) -> DataFrame:
    return _finding(lines.where(T.has("text", V.SENSITIVE_LOG, True)), "security", "sensitive_log", "medium", "log statement appears to include a sensitive value", "line", None, F.lit(940))


def analyze_security(lines: DataFrame) -> DataFrame:
    return _union([secrets(lines), sql_injection(lines), unsafe_deserialization(lines), weak_auth(lines), sensitive_logs(lines)])


# --- performance -------------------------------------------------------------


def n_plus_one(lines: DataFrame) -> DataFrame:
    """A loop's header with a query call in the lines after it."""
    w = W.partitionBy("job_id", "path").orderBy("line").rowsBetween(1, V.LOOP_WINDOW)
    x = lines.select("job_id", "file_seq", "path", "line", T.has("text", V.LOOP).alias("_loop"), T.has("text", V.QUERY_CALL, True).alias("_q"))
    x = x.withColumn("_near", F.max("_q").over(w)).where("_loop AND _near")
    return _finding(x, "performance", "n_plus_one_query", "high", "query call inside a loop — likely N+1; consider batching/prefetching", "line")


def blocking_calls(lines: DataFrame) -> DataFrame:
    """For each async header, every blocking call in the lines after it."""
    w = W.partitionBy("job_id", "path").orderBy("line").rowsBetween(1, V.ASYNC_WINDOW)
    calls = F.array_compact(F.array(*[F.when(T.has("text", p), F.regexp_extract("text", T.rx(p), 0)) for p in V.BLOCKING]))
    x = lines.select("job_id", "file_seq", "path", "line", T.has("text", V.ASYNC).alias("_a"), calls.alias("_c"))
    x = x.withColumn("_near", F.flatten(F.collect_list("_c").over(w))).where("_a").select("*", F.posexplode("_near").alias("_i", "call"))
    return _finding(x, "performance", "blocking_call", "medium", F.concat(F.lit("blocking call '"), F.col("call"), F.lit("' inside an async function — use its async equivalent")), "line", None, F.col("_i"))


def runs(calls: Column) -> Column:
    """call, n, first: the calls of an array, how often each stands there and at what place
    first.  Sorted, equal ones are neighbours: a run's length is the distance of its ends."""
    n = F.size(calls)
    pairs = F.array_sort(F.transform(calls, lambda c, i: F.struct(c.alias("call"), i.alias("at"))))

    def cut(s):
        last = F.size(s) - 1
        other = lambda i, j: ~F.get(s, i)["call"].eqNullSafe(F.get(s, j)["call"])
        ends = lambda at_end: F.filter(F.sequence(F.lit(0), last), at_end)
        starts = ends(lambda i: (i == 0) | other(i, i - 1))
        stops = ends(lambda i: (i == last) | other(i, i + 1))
        return F.zip_with(starts, stops, lambda i, j: F.struct(F.get(s, i)["call"].alias("call"), (j - i + 1).alias("n"), F.get(s, i)["at"].alias("first")))

    return F.when(n > 0, T.let(pairs, cut))


def missing_cache(bodies: DataFrame) -> DataFrame:
    """Calls are counted within the function's row: no shuffle."""
    x = bodies.where("kind <> 'class'").where(~T.has(F.array_join("body", "\n"), V.CACHE_HINT, True))
    x = x.select("job_id", "file_seq", "path", "sym_seq", "name", "start_line", F.explode(F.filter(runs(F.col("calls")), lambda r: r["n"] >= 3)).alias("r"))
    return _finding(x, "performance", "missing_cache", "low", F.format_string("'%s' is called %d times in '%s' with no visible caching/memoization", "r.call", "r.n", "name"), "start_line", "name", F.col("sym_seq") * 1000 + F.col("r.first"))


def expensive_loops(functions: DataFrame) -> DataFrame:
    x = functions.where("max_loop_nesting >= 2")
    return _finding(x, "performance", "expensive_loop", "medium", F.format_string("'%s' has %d nested loops — likely O(n^%d) or worse", "name", "max_loop_nesting", "max_loop_nesting"), "start_line", "name", F.lit(1 << 60) + F.col("sym_seq"))


def analyze_performance(code: Code) -> DataFrame:
    lines = code.lines
    return _union([n_plus_one(lines), blocking_calls(lines), missing_cache(code.bodies), expensive_loops(code.functions)])
