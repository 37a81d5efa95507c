"""The queries of the engine's operators over the driver's tables, and their SQL.

Keys begin with the operator's identifier.  The SQL is written on its own, from the
rules, for DuckDB; both sides start from the same made-up code (fixtures.py)."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.udf import ship
from ..operators import api_surface, architecture, database, design, diagrams, ecosystem, findings, graph, parsing, retrieval, scoring, summary
from ..sources.store import shared_folder
from .fixtures import frame, sql_of

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(name: str, sql: str | None = None, *fixtures: str):
    """Registers a query; its SQL begins with the fixtures as tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            head = ", ".join(f"{x} AS ({sql_of(x)})" for x in fixtures)
            body = sql.strip()
            if head:
                body = f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
            ORACLE_SQL[name] = body
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quote(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


# --- files, languages, summary -----------------------------------------------

_suffix_case = " ".join(f"WHEN suffix = '{s}' THEN '{l}'" for s, l in V.LANGUAGE_SUFFIXES.items())
_name_case = " ".join(f"WHEN base = '{n}' THEN '{l}'" for n, l in V.LANGUAGE_NAMES.items())
_LANG = f"""SELECT *, CASE {_name_case} {_suffix_case} ELSE 'other' END AS language FROM (
  SELECT *, lower(regexp_extract(base, '^.+(\\.[^.]+)$', 1)) AS suffix FROM (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM code_files))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = frame(spark, sf_dir, "code_files")
    return x.withColumn("language", T.language("path"))


@_query("PAR1_detect_language", f"WITH f AS ({_LANG}) SELECT path, language, count(*) AS n FROM f GROUP BY ALL", "code_files")
def _(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("path", "language").agg(F.count("*").alias("n"))


@_query("SRC9_SRC10_kept_paths", f"""SELECT path, count(*) AS n FROM code_files
WHERE len(list_intersect(string_split(path, '/')[:-2], [{_quote(V.IGNORED_DIRS)}])) = 0 AND NOT regexp_extract(path, '[^/]*$') IN ({_quote(V.IGNORED_NAMES)})
AND NOT ({' OR '.join(f"ends_with(lower(regexp_extract(path, '[^/]*$')), '{s}')" for s in V.IGNORED_SUFFIXES)}) GROUP BY path""", "code_files")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "code_files").where(T.is_kept_path("path")).groupBy("path").agg(F.count("*").alias("n"))


@_query("SUM1_totals", "SELECT job_id, count(*) AS total_files, CAST(sum(loc) AS BIGINT) AS total_loc FROM code_files GROUP BY job_id", "code_files")
def _(spark, sf_dir):
    return summary.totals(_files(spark, sf_dir))


@_query("SUM2_languages", f"WITH f AS ({_LANG}) SELECT job_id, language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, min(file_seq) AS first_seq FROM f GROUP BY job_id, language", "code_files")
def _(spark, sf_dir):
    return summary.languages(_files(spark, sf_dir))


@_query("SUM3_primary_language", f"""WITH f AS ({_LANG}), g AS (SELECT job_id, language, sum(loc) AS loc, min(file_seq) AS s FROM f WHERE language NOT IN ({_quote(V.NOT_CODE)}) GROUP BY ALL)
SELECT job_id, language AS primary_language FROM g QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY loc DESC, s) = 1""", "code_files")
def _(spark, sf_dir):
    return summary.primary_language(_files(spark, sf_dir))


@_query("SUM4_SUM5_folders", f"""WITH f AS ({_LANG}), a AS (SELECT job_id, language, loc, file_seq, string_split(path, '/') AS p FROM f),
b AS (SELECT job_id, language, loc, file_seq, p, unnest(range(0, len(p))) AS d FROM a), c AS (SELECT *, array_to_string(p[1:d], '/') AS path FROM b),
l AS (SELECT job_id, path, language, count(*) AS n, min(file_seq) AS s FROM c GROUP BY ALL),
t AS (SELECT job_id, path, language FROM l QUALIFY row_number() OVER (PARTITION BY job_id, path ORDER BY n DESC, s) = 1)
SELECT c.job_id, c.path, regexp_extract(c.path, '[^/]*$') AS name, CASE WHEN c.path = '' THEN NULL ELSE array_to_string(string_split(c.path, '/')[:-2], '/') END AS parent_path, count(*) AS file_count, CAST(sum(loc) AS BIGINT) AS loc, any_value(t.language) AS primary_language
FROM c JOIN t ON c.job_id = t.job_id AND c.path = t.path GROUP BY c.job_id, c.path""", "code_files")
def _(spark, sf_dir):
    return summary.folders(_files(spark, sf_dir))


# --- duplicate blocks --------------------------------------------------------

_WS = r"\s\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@_query("QUA7_duplicate_blocks", f"""WITH a AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || '.md' AS path, list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: regexp_replace(s, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS l, text FROM documents),
b AS (SELECT doc_id, path, l, unnest(range(1, len(l) - CASE WHEN l[-1] = '' AND regexp_matches(coalesce(text, ''), '[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]$') OR coalesce(text, '') = '' THEN 1 ELSE 0 END - 4)) AS line FROM a),
c AS (SELECT doc_id, path, line, l[line:line + 5] AS w FROM b),
d AS (SELECT doc_id, path, line, array_to_string(w, chr(10)) AS t FROM c WHERE len(list_filter(w, lambda s: s <> '')) >= 5),
e AS (SELECT sha1(t) AS digest, doc_id, path, line FROM d WHERE length(t) >= 40)
SELECT digest, count(*) AS n, min_by(path, (doc_id, line)) AS first_path, min((doc_id, line)).line AS first_line FROM (SELECT digest, path, doc_id, CAST(line AS INT) AS line FROM e) GROUP BY digest HAVING count(*) > 1""".replace("min((doc_id, line)).line", "min_by(line, (doc_id, line))"))
def _(spark, sf_dir):
    """Blocks of six lines that stand in two or more places, each document a file."""
    x = _table(spark, sf_dir, "documents").select(F.lit("j").alias("job_id"), F.col("doc_id").alias("file_seq"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("source"))
    d = findings.duplicate_blocks(x)
    return d.select("digest", "n", F.concat(F.col("first_seen.file_seq").cast("string"), F.lit(".md")).alias("first_path"), F.col("first_seen.line").alias("first_line"))


# --- security ----------------------------------------------------------------

_OUT = "job_id, path AS file, line, category, severity, message"


def _found(df: DataFrame) -> DataFrame:
    return df.select("job_id", "file", "line", "category", "severity", "message")


def _line_query(name, detector, where, category, severity, message, pre="SELECT * FROM code_lines"):
    sql = f"SELECT job_id, path AS file, line, '{category}' AS category, '{severity}' AS severity, {message} AS message FROM ({pre}) WHERE {where}"

    @_query(name, sql, "code_lines")
    def _(spark, sf_dir):
        return _found(detector(frame(spark, sf_dir, "code_lines")))


_m = lambda p, o="": f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}'{', ' + repr(o) if o else ''})"
_env = " AND ".join(f"NOT contains(text, '{h}')" for h in V.ENV_HINTS)
_secret = V.SECRET.replace("'", "''")


@_query("SEC1_SEC2_secrets", f"""WITH a AS (SELECT * FROM code_lines WHERE {_env}),
b AS (SELECT job_id, path, line, unnest(regexp_extract_all(text, '{_secret}', 1, 'i')) AS k, unnest(regexp_extract_all(text, '{_secret}', 2, 'i')) AS v FROM a),
c AS (SELECT job_id, path, line, 'possible hardcoded ' || k AS message FROM b WHERE NOT lower(v) IN ({_quote(V.PLACEHOLDERS)}) AND NOT starts_with(v, '${{') AND NOT starts_with(v, '{{{{')
UNION ALL SELECT job_id, path, line, 'AWS access key ID literal found' FROM a WHERE {_m(V.AWS_KEY)}
UNION ALL SELECT job_id, path, line, 'private key material committed to source' FROM a WHERE {_m(V.PRIVATE_KEY)})
SELECT job_id, path AS file, line, 'hardcoded_secret' AS category, 'critical' AS severity, message FROM c""", "code_lines")
def _(spark, sf_dir):
    return _found(findings.secrets(frame(spark, sf_dir, "code_lines")))


_line_query("SEC3_sql_injection", findings.sql_injection, "(" + " OR ".join(_m(p) for p in V.SQL_INJECTION) + ")", "sql_injection", "high", "'user input may be interpolated directly into a SQL query — use parameterized queries'")
_why = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for (_, r), c in zip(V.DESERIALIZATION, (_m(r"\bpickle\.loads?\("), _m(r"\byaml\.load\(") + " AND NOT contains(text, 'SafeLoader')", _m(r"\beval\("), _m(r"\bexec\("), _m(r"\bunserialize\("), _m(r"\bObjectInputStream\b")), strict=True)) + " END"
_line_query("SEC4_unsafe_deserialization", findings.unsafe_deserialization, "w IS NOT NULL", "unsafe_deserialization", "high", "w", f"SELECT *, {_why} AS w FROM code_lines")
_line_query("SEC5_weak_auth", findings.weak_auth, _m(V.WEAK_HASH, "i") + " AND contains(lower(text), 'password')", "weak_auth", "high", "'MD5/SHA1 is not suitable for password hashing — use bcrypt/argon2/scrypt'")
_line_query("SEC6_sensitive_log", findings.sensitive_logs, _m(V.SENSITIVE_LOG, "i"), "sensitive_log", "medium", "'log statement appears to include a sensitive value'")


@_query("QUA9_severity_order", f"""WITH f AS (SELECT job_id, 'high' AS severity, path AS file, file_seq, line, 'weak_auth' AS category FROM code_lines WHERE {_m(V.WEAK_HASH, "i")} AND contains(lower(text), 'password')
UNION ALL SELECT job_id, 'medium', path, file_seq, line, 'sensitive_log' FROM code_lines WHERE {_m(V.SENSITIVE_LOG, "i")})
SELECT job_id, file, line, category, severity, CAST(row_number() OVER (PARTITION BY job_id ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, file_seq, file, line) AS INT) AS position FROM f""", "code_lines")
def _(spark, sf_dir):
    x = frame(spark, sf_dir, "code_lines")
    return findings.by_severity(findings.weak_auth(x).unionByName(findings.sensitive_logs(x))).select("job_id", "file", "line", "category", "severity", "position")


# --- performance -------------------------------------------------------------


@_query("PER1_n_plus_one", f"""WITH a AS (SELECT *, {_m(V.LOOP)} AS l, {_m(V.QUERY_CALL, "i")} AS q FROM code_lines),
b AS (SELECT *, max(q) OVER (PARTITION BY job_id, path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS near FROM a)
SELECT job_id, path AS file, line FROM b WHERE l AND near""", "code_lines")
def _(spark, sf_dir):
    return findings.n_plus_one(frame(spark, sf_dir, "code_lines")).select("job_id", "file", "line")


@_query("PER2_blocking_calls", f"""WITH h AS (SELECT job_id, path, line FROM code_lines WHERE {_m(V.ASYNC)}),
p AS (SELECT job_id, path, line, unnest([{", ".join(f"regexp_extract(text, '{p}')" for p in V.BLOCKING)}]) AS call FROM code_lines)
SELECT h.job_id, h.path AS file, h.line, 'blocking call ''' || call || ''' inside an async function — use its async equivalent' AS message
FROM h JOIN p ON h.job_id = p.job_id AND h.path = p.path AND p.line BETWEEN h.line + 1 AND h.line + 15 WHERE call <> ''""", "code_lines")
def _(spark, sf_dir):
    return findings.blocking_calls(frame(spark, sf_dir, "code_lines")).select("job_id", "file", "line", "message")


@_query("PER3_missing_cache", """SELECT l_orderkey AS sym, call, count(*) AS n FROM (SELECT l_orderkey, 'f' || CAST(l_suppkey % 5 AS VARCHAR) AS call FROM lineitem) GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, sf_dir):
    """Orders as functions, their lines as calls."""
    l = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string"))).alias("calls"))
    x = l.select(F.lit("j").alias("job_id"), F.lit(0).cast("long").alias("file_seq"), F.lit("a.py").alias("path"), F.lit("function").alias("kind"), F.col("l_orderkey").alias("sym_seq"), F.col("l_orderkey").cast("string").alias("name"), F.lit(1).alias("start_line"), "calls", F.array(F.lit("body")).alias("body"))
    m = findings.missing_cache(x)
    return m.select(F.col("symbol").cast("long").alias("sym"), F.regexp_extract("message", "^'([^']*)'", 1).alias("call"), F.regexp_extract("message", r"called (\d+) times", 1).cast("long").alias("n"))


@_query("PER4_expensive_loops", "SELECT job_id, path AS file, name AS symbol, start_line AS line, '''' || name || ''' has ' || max_loop_nesting || ' nested loops — likely O(n^' || max_loop_nesting || ') or worse' AS message FROM functions WHERE max_loop_nesting >= 2", "functions")
def _(spark, sf_dir):
    return findings.expensive_loops(frame(spark, sf_dir, "functions")).select("job_id", "file", "symbol", "line", "message")


# --- quality -----------------------------------------------------------------


@_query("QUA1_metrics", "SELECT job_id, count(*) AS total_functions, round_even(avg(complexity), 2) AS average_complexity, max(complexity) AS max_complexity, count(*) FILTER (WHERE complexity > 10) AS high_complexity_functions FROM functions GROUP BY job_id", "functions")
def _(spark, sf_dir):
    return findings.quality_metrics(frame(spark, sf_dir, "functions"))


@_query("QUA2_QUA3_QUA4_functions", """SELECT job_id, path AS file, start_line AS line, name AS symbol, 'high_complexity' AS category, CASE WHEN complexity > 20 THEN 'high' ELSE 'medium' END AS severity FROM functions WHERE complexity > 10
UNION ALL SELECT job_id, path, start_line, name, 'long_method', 'medium' FROM functions WHERE end_line - start_line + 1 > 50 UNION ALL SELECT job_id, path, start_line, name, 'deep_nesting', 'medium' FROM functions WHERE max_nesting_depth > 4""", "functions")
def _(spark, sf_dir):
    f = frame(spark, sf_dir, "functions")
    x = findings.complex_functions(f).unionByName(findings.long_methods(f)).unionByName(findings.deep_nesting(f))
    return x.select("job_id", "file", "line", "symbol", "category", "severity")


def _code(spark, sf_dir):
    return SimpleNamespace(functions=frame(spark, sf_dir, "functions"), classes=frame(spark, sf_dir, "classes"))


_COUNTED = """m AS (SELECT job_id, path, parent_class AS name, count(*) AS methods, list(DISTINCT lower(name)) AS method_names FROM functions WHERE parent_class IS NOT NULL GROUP BY ALL),
c AS (SELECT classes.*, coalesce(methods, 0) AS methods, coalesce(method_names, []) AS method_names, end_line - start_line + 1 AS n FROM classes LEFT JOIN m USING (job_id, path, name))"""


@_query("QUA5_large_classes", f"""WITH {_COUNTED} SELECT job_id, path AS file, start_line AS line, name AS symbol, CASE WHEN methods > 20 THEN 'god_class' ELSE 'large_class' END AS category,
CASE WHEN methods > 20 THEN '''' || name || ''' is a god class: ' || n || ' lines, ' || methods || ' methods' ELSE '''' || name || ''' is ' || n || ' lines long (> 300)' END AS message FROM c WHERE n > 300""", "functions", "classes")
def _(spark, sf_dir):
    return findings.large_classes(findings.with_method_counts(_code(spark, sf_dir))).select("job_id", "file", "line", "symbol", "category", "message")


@_query("QUA8_dead_code", """WITH u AS (SELECT job_id, name AS short, any_value(path || '::' || CASE WHEN parent_class IS NULL THEN '' ELSE parent_class || '.' END || name) AS target FROM functions GROUP BY ALL HAVING count(*) = 1),
k AS (SELECT job_id, path || '::' || CASE WHEN parent_class IS NULL THEN '' ELSE parent_class || '.' END || name AS id, unnest(calls) AS call FROM functions),
called AS (SELECT DISTINCT k.job_id, u.target AS id FROM k JOIN u ON k.job_id = u.job_id AND u.short = regexp_extract(call, '[^.]*$') WHERE u.target <> k.id)
SELECT job_id, path AS file, start_line AS line, name AS symbol FROM functions f WHERE kind = 'function' AND name NOT IN ('main', '__init__', '__new__', 'setup', 'handler', 'run') AND NOT EXISTS (SELECT 1 FROM called c WHERE c.job_id = f.job_id AND c.id = f.path || '::' || f.name)""", "functions")
def _(spark, sf_dir):
    f = frame(spark, sf_dir, "functions").withColumn("id", T.symbol_id("path", "name", "parent_class"))
    return findings.dead_functions(f.withColumn("decorators", F.array().cast("array<string>")), graph.calls_edges(f)).select("job_id", "file", "line", "symbol")


# --- patterns and SOLID ------------------------------------------------------


@_query("PAT1_PAT10_class_patterns", f"""WITH {_COUNTED}, s AS (SELECT job_id, regexp_extract(b, '[^.]*$') AS name, count(*) AS subs FROM (SELECT job_id, unnest(base_classes) AS b FROM classes) GROUP BY ALL),
d AS (SELECT c.*, coalesce(subs, 0) AS subs FROM c LEFT JOIN s USING (job_id, name)), h AS (SELECT *, unnest([CASE WHEN ends_with(name, 'Factory') THEN 'Factory' END, CASE WHEN ends_with(name, 'Builder') AND list_contains(method_names, 'build') THEN 'Builder' END,
CASE WHEN ends_with(name, 'Repository') AND len(list_intersect(method_names, [{_quote(V.CRUD)}])) >= 2 THEN 'Repository' END, CASE WHEN ends_with(name, 'Strategy') OR subs >= 2 THEN 'Strategy' END, CASE WHEN ends_with(name, 'Adapter') THEN 'Adapter' END, CASE WHEN ends_with(name, 'Facade') THEN 'Facade' END,
CASE WHEN regexp_matches(name, '(Observer|Listener|Subscriber)$') OR len(list_intersect(method_names, [{_quote(V.PUBSUB)}])) >= 2 THEN 'Observer' END, CASE WHEN ends_with(name, 'Decorator') THEN 'Decorator' END, CASE WHEN ends_with(name, 'Command') AND len(list_intersect(method_names, ['execute', 'run', 'handle'])) > 0 THEN 'Command' END]) AS pattern FROM d)
SELECT job_id, pattern, path AS file, name AS symbol, start_line AS line FROM h WHERE pattern IS NOT NULL""", "functions", "classes")
def _(spark, sf_dir):
    c = _code(spark, sf_dir)
    x = findings.with_method_counts(c).join(design.subclass_counts(c.classes), ["job_id", "name"], "left").withColumn("body", F.array(F.lit("")))
    return design.class_patterns(x).select("job_id", "pattern", "file", "symbol", "line")


@_query("PAT11_factory_functions", "SELECT job_id, path AS file, name AS symbol, start_line AS line, 'function ''' || name || ''' has a create/make/build name and branches (' || complexity || ' paths) to produce different results' AS reason FROM functions WHERE kind = 'function' AND regexp_matches(lower(name), '^(create_|make_|build_)') AND complexity > 2", "functions")
def _(spark, sf_dir):
    return design.factory_functions(frame(spark, sf_dir, "functions")).select("job_id", "file", "symbol", "line", "reason")


@_query("PAT13_cqrs", """WITH k AS (SELECT *, CASE WHEN ends_with(name, 'Command') THEN 'c' WHEN ends_with(name, 'Query') THEN 'q' WHEN ends_with(name, 'Handler') THEN 'h' END AS k FROM classes),
g AS (SELECT job_id, count(*) FILTER (k = 'c') AS c, count(*) FILTER (k = 'q') AS q, count(*) FILTER (k = 'h') AS h FROM k GROUP BY job_id),
f AS (SELECT job_id, path, name, start_line FROM k WHERE k IN ('c', 'q') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY k, file_seq, sym_seq) = 1)
SELECT job_id, path AS file, name AS symbol, start_line AS line FROM g JOIN f USING (job_id) WHERE c + q >= 2 AND h >= 2""", "classes")
def _(spark, sf_dir):
    return design.cqrs(frame(spark, sf_dir, "classes")).select("job_id", "file", "symbol", "line")


@_query("SOL1_SOL4_classes", f"""WITH {_COUNTED} SELECT job_id, 'SRP' AS principle, path AS file, name AS symbol, start_line AS line, '''' || name || ''' has ' || methods || ' methods across ' || n || ' lines — likely handling more than one responsibility' AS message FROM c WHERE methods > 15 OR n > 300
UNION ALL SELECT job_id, 'ISP', path, name, start_line, 'interface ''' || name || ''' declares ' || methods || ' methods — implementers are forced to depend on methods they may not use' FROM c WHERE regexp_matches(name, '^I[A-Z]') AND methods > 7""", "functions", "classes")
def _(spark, sf_dir):
    c = findings.with_method_counts(_code(spark, sf_dir))
    return design.srp(c).unionByName(design.isp(c)).select("job_id", "principle", "file", "symbol", "line", "message")


@_query("SOL2_type_switches", r"""WITH g AS (SELECT job_id, path, count(*) FILTER (WHERE regexp_matches(text, '\.(type|kind|status|category)\s*==')) AS n FROM code_lines GROUP BY ALL) SELECT job_id, path AS file, n FROM g WHERE n >= 3""", "code_lines")
def _(spark, sf_dir):
    """Each file as the body of one function."""
    x = frame(spark, sf_dir, "code_lines").groupBy("job_id", "path", "file_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]).alias("body"))
    v = design.ocp(x.select("job_id", "path", "file_seq", "body", F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit(1).alias("start_line"), F.lit(0).alias("sym_seq")))
    return v.select("job_id", "file", F.regexp_extract("message", r"branches (\d+) times", 1).cast("long").alias("n"))


@_query("SOL5_SOL6_direct_construction", """WITH n AS (SELECT DISTINCT job_id, name AS short FROM classes), m AS (SELECT job_id, path, sym_seq, parent_class, name, unnest(calls) AS call, unnest(range(0, len(calls))) AS pos FROM functions WHERE parent_class IS NOT NULL AND name NOT IN ('__init__', 'constructor') AND name <> parent_class),
k AS (SELECT m.* FROM m JOIN n ON m.job_id = n.job_id AND n.short = regexp_extract(call, '[^.]*$') QUALIFY row_number() OVER (PARTITION BY m.job_id, path, sym_seq ORDER BY pos) = 1)
SELECT k.job_id, k.path AS file, parent_class || '.' || k.name AS symbol, call, count(*) AS n FROM k JOIN classes c ON c.job_id = k.job_id AND c.path = k.path AND c.name = k.parent_class GROUP BY ALL""", "functions", "classes")
def _(spark, sf_dir):
    c = _code(spark, sf_dir)
    x = design.dip_counts(c.classes, c.functions)
    return x.groupBy("job_id", F.col("path").alias("file"), F.concat("parent_class", F.lit("."), "name").alias("symbol"), "call").agg(F.sum("owners").alias("n"))


# --- graph -------------------------------------------------------------------

_ROOT = """CASE WHEN regexp_replace(raw, '^[./ ]+|[./ ]+$', '', 'g') = '' THEN raw ELSE CASE WHEN starts_with(t, '@') AND contains(t, '/') THEN array_to_string(string_split(t, '/')[1:2], '/') WHEN contains(t, '/') THEN split_part(t, '/', 1) ELSE split_part(t, '.', 1) END END"""
_RESOLVED = f"""a AS (SELECT *, regexp_replace(raw, '^[./ ]+|[./ ]+$', '', 'g') AS t, lower(regexp_extract(regexp_extract(raw, '[^/]*$'), '[^.]*$')) AS short,
  CASE WHEN starts_with(raw, './') THEN regexp_replace(path, '[^/]*$', '') || substr(raw, 3) WHEN starts_with(raw, '../') THEN regexp_replace(path, '[^/]*/[^/]*$', '') || substr(raw, 4) END AS base FROM imports),
s AS (SELECT job_id, lower(regexp_extract(path, '([^/]*)\\.[^.]*$', 1)) AS short, any_value(path) AS by_stem FROM web_files GROUP BY ALL HAVING count(*) = 1),
r AS (SELECT a.*, coalesce(w.path, s.by_stem) AS target FROM a LEFT JOIN web_files w ON w.job_id = a.job_id AND w.path = a.base || '.ts' LEFT JOIN s ON s.job_id = a.job_id AND s.short = a.short)"""


@_query("GRA5_package_root", f"WITH a AS (SELECT raw, regexp_replace(raw, '^[./ ]+|[./ ]+$', '', 'g') AS t FROM imports) SELECT raw, {_ROOT} AS root, count(*) AS n FROM a GROUP BY ALL", "imports")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "imports").groupBy("raw", graph.package_root(F.col("raw")).alias("root")).agg(F.count("*").alias("n"))


@_query("GRA4_GRA6_GRA7_import_edges", f"WITH {_RESOLVED} SELECT job_id, path AS source, coalesce(target, 'external::' || {_ROOT}) AS target, raw, imp_seq AS seq FROM r", "imports", "web_files")
def _(spark, sf_dir):
    e = graph.import_edges(frame(spark, sf_dir, "imports"), frame(spark, sf_dir, "web_files"))
    return e.select("job_id", "source", "target", "raw", "seq")


@_query("GRA8_inherits_edges", """WITH c AS (SELECT *, path || '::' || name AS id FROM classes), u AS (SELECT job_id, name AS short, any_value(id) AS target FROM c GROUP BY ALL HAVING count(*) = 1), b AS (SELECT job_id, id, unnest(base_classes) AS base FROM c)
SELECT b.job_id, b.id AS source, u.target, count(*) AS n FROM b JOIN u ON u.job_id = b.job_id AND u.short = regexp_extract(base, '[^.]*$') WHERE u.target <> b.id GROUP BY ALL""", "classes")
def _(spark, sf_dir):
    c = frame(spark, sf_dir, "classes").withColumn("id", T.symbol_id("path", "name"))
    return graph.inherits_edges(c).groupBy("job_id", "source", "target").agg(F.count("*").alias("n"))


@_query("GRA9_calls_edges", """WITH f AS (SELECT *, path || '::' || CASE WHEN parent_class IS NULL THEN '' ELSE parent_class || '.' END || name AS id FROM functions), u AS (SELECT job_id, name AS short, any_value(id) AS target FROM f GROUP BY ALL HAVING count(*) = 1), b AS (SELECT job_id, id, unnest(calls) AS call FROM f)
SELECT b.job_id, b.id AS source, u.target, count(*) AS n FROM b JOIN u ON u.job_id = b.job_id AND u.short = regexp_extract(call, '[^.]*$') WHERE u.target <> b.id GROUP BY ALL""", "functions")
def _(spark, sf_dir):
    f = frame(spark, sf_dir, "functions").withColumn("id", T.symbol_id("path", "name", "parent_class"))
    return graph.calls_edges(f).groupBy("job_id", "source", "target").agg(F.count("*").alias("n"))


@_query("GRA3_defines_edges", """WITH o AS (SELECT DISTINCT job_id, path || '::' || name AS id FROM classes), e AS (SELECT job_id, path AS source, path || '::' || name AS target FROM classes UNION ALL SELECT job_id, path, path || '::' || name FROM functions WHERE parent_class IS NULL
UNION ALL SELECT f.job_id, o.id, f.path || '::' || parent_class || '.' || name FROM functions f JOIN o ON o.job_id = f.job_id AND o.id = f.path || '::' || parent_class) SELECT job_id, source, target, count(*) AS n FROM e GROUP BY ALL""", "functions", "classes")
def _(spark, sf_dir):
    c = frame(spark, sf_dir, "classes").withColumn("id", T.symbol_id("path", "name"))
    f = frame(spark, sf_dir, "functions").withColumn("id", T.symbol_id("path", "name", "parent_class"))
    return graph.defines_edges(c, f).groupBy("job_id", "source", "target").agg(F.count("*").alias("n"))


# --- architecture, ecosystem -------------------------------------------------

_SEEN = f"""p AS (SELECT job_id, path, string_split(path, '/')[:-2] AS d, regexp_extract(path, '[^/]*$') AS b FROM code_files),
o AS (SELECT job_id, list_distinct(flatten(list(list_transform(d, lambda s: lower(s))))) AS folders, list(DISTINCT lower(b)) AS names, count(DISTINCT CASE WHEN len(d) > 0 AND lower(b) IN ({_quote(V.MANIFESTS)}) THEN d[1] END) AS services, count(*) FILTER (b = 'Dockerfile') AS dockerfiles FROM p GROUP BY job_id)"""


@_query("ARC1_ARC2_ARC3_observations", f"WITH {_SEEN} SELECT o.job_id, services, dockerfiles, CAST(len(folders) AS INT) AS n_folders, o.job_id IN (SELECT job_id FROM imports WHERE lower(raw) IN ({_quote(V.BROKERS)})) AS broker FROM o", "code_files", "imports")
def _(spark, sf_dir):
    x = architecture.observations(_files(spark, sf_dir), frame(spark, sf_dir, "imports"))
    return x.select("job_id", "services", "dockerfiles", F.size("folders").alias("n_folders"), "broker")


@_query("ARC4_ARC5_ARC6_style", f"""WITH {_SEEN}, k AS (SELECT DISTINCT job_id FROM imports WHERE lower(raw) IN ({_quote(V.BROKERS)})), h AS (SELECT o.*, k.job_id IS NOT NULL AS broker, list_has_any(folders, ['controllers', 'controller']) AS ctl FROM o LEFT JOIN k USING (job_id)),
c AS (SELECT job_id, unnest([{{'s': 'Microservices', 'i': 0, 'c': 100 * (4 * CAST(services >= 2 AS INT) + 3 * CAST(dockerfiles >= 2 AS INT) + 2 * CAST(list_has_any(names, ['docker-compose.yml', 'docker-compose.yaml']) AS INT)) / 9}},
{{'s': 'Serverless', 'i': 1, 'c': 100 * (4 * CAST(list_contains(names, 'serverless.yml') AS INT) + 3 * CAST(list_has_any(names, ['template.yaml', 'template.yml']) AS INT) + 2 * CAST(list_has_any(names, ['handler.py', 'lambda_function.py', 'index.mjs']) AS INT)) / 9}},
{{'s': 'Event-Driven', 'i': 4, 'c': 100 * (4 * CAST(list_has_any(folders, ['consumers', 'producers', 'handlers', 'subscribers']) AS INT) + 3 * CAST(broker AS INT)) / 7}},
{{'s': 'Layered', 'i': 5, 'c': 100 * (3 * CAST(ctl AND list_has_any(folders, ['services', 'service']) AS INT) + 2 * CAST(list_has_any(folders, ['repositories', 'repository', 'dao']) AS INT)) / 5}},
{{'s': 'MVC', 'i': 6, 'c': 100 * (4 * CAST(ctl AND list_has_any(folders, ['models', 'model']) AND list_has_any(folders, ['views', 'view']) AS INT) + 2 * CAST(list_contains(names, 'models.py') AND list_contains(names, 'views.py') AND list_contains(names, 'urls.py') AS INT)) / 6}},
{{'s': 'Monolith', 'i': 7, 'c': 100 * (2 * CAST(services <= 1 AS INT) + CAST(dockerfiles <= 1 AND NOT list_contains(names, 'docker-compose.yml') AS INT)) / 3}}]) AS x FROM h)
SELECT job_id, x.s AS primary_style, CAST(round_even(x.c, 0) AS INT) AS confidence FROM c WHERE x.s = 'Monolith' OR round_even(x.c, 0) >= 25 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY x.s = 'Monolith', round_even(x.c, 0) DESC, x.i) = 1""", "code_files", "imports")
def _(spark, sf_dir):
    return architecture.detect_architecture(_files(spark, sf_dir), frame(spark, sf_dir, "imports")).select("job_id", "primary_style", "confidence")


@_query("PAR14_PAR15_json_keys", "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def _(spark, sf_dir):
    """Keys of JSON objects, as manifests are read."""
    x = _table(spark, sf_dir, "events").select(F.concat(F.lit('{"dependencies":'), "props", F.lit("}")).alias("content"))
    return x.select(F.explode(ecosystem.json_keys(F.col("content"), "dependencies", "devDependencies")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@_query("PAR16_requirements", "WITH a AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS l FROM documents) SELECT doc_id, count(DISTINCT regexp_extract(trim(l), '^[^=<>~\\[; ]*')) AS n FROM a WHERE trim(l) <> '' GROUP BY doc_id")
def _(spark, sf_dir):
    """First tokens of lines, each document a requirements file."""
    x = _table(spark, sf_dir, "documents").select("doc_id", ecosystem.requirement_names(F.coalesce("text", F.lit(""))).alias("r")).where(F.size("r") > 0)
    return x.select("doc_id", F.size(F.array_distinct("r")).cast("long").alias("n"))


# --- API, database -----------------------------------------------------------

_ENDS = """e AS (SELECT job_id, path AS file, 'GET' AS method, '/p' || file_seq AS path, 2 AS line, 'fastapi/flask' AS framework FROM sources WHERE file_seq % 5 <> 0
UNION ALL SELECT job_id, path, 'POST', '/q', 4, 'express' FROM sources WHERE file_seq % 5 <> 0 AND file_seq % 3 = 0 UNION ALL SELECT job_id, path, 'ANY', '/r', 5, 'flask' FROM sources WHERE file_seq % 5 <> 0 AND file_seq % 3 = 0)"""


@_query("API1_endpoints", f"WITH {_ENDS} SELECT * FROM e", "sources")
def _(spark, sf_dir):
    return api_surface.endpoints(frame(spark, sf_dir, "sources")).select("job_id", "file", "method", "path", "line", "framework")


@_query("API2_API3_protocols_auth", f"""WITH i AS (SELECT job_id, lower(raw) AS r FROM imports), {_ENDS}, j AS (SELECT DISTINCT job_id FROM sources)
SELECT j.job_id, CASE WHEN j.job_id IN (SELECT job_id FROM e) THEN 'REST' ELSE '' END AS protocols, CASE WHEN j.job_id IN (SELECT job_id FROM sources WHERE contains(source, '@login_required')) THEN 'Flask decorator-based auth' ELSE '' END AS mechanisms, (SELECT count(*) FROM e WHERE e.job_id = j.job_id) AS endpoint_count FROM j""", "sources", "imports")
def _(spark, sf_dir):
    s = frame(spark, sf_dir, "sources")
    none = spark.createDataFrame([], "job_id string, kind string, name string, decorators array<string>")
    x = api_surface.detect_api_surface(s, none, frame(spark, sf_dir, "imports"))
    return x.select("job_id", F.array_join("protocols", ",").alias("protocols"), F.array_join("mechanisms", ",").alias("mechanisms"), "endpoint_count")


@_query("DB10_DB11_prisma_relations", """WITH t AS (SELECT job_id, file_seq, 'M' || file_seq AS name, 'M' || (file_seq + 20) AS fk FROM sources WHERE file_seq % 5 = 0) SELECT a.job_id, a.name AS "from", b.name AS "to", 'owner' AS via FROM t a JOIN t b ON a.job_id = b.job_id AND b.name = a.fk""", "sources")
def _(spark, sf_dir):
    return database.relationships(database.prisma_models(frame(spark, sf_dir, "sources"))).select("job_id", "from", "to", "via")


# --- scores ------------------------------------------------------------------


@_query("SCO2_penalties", """WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderpriority LIKE '1%') AS a, count(*) FILTER (o_orderpriority LIKE '2%') AS b, count(*) FILTER (o_orderpriority LIKE '3%') AS c, count(*) FILTER (o_orderpriority LIKE '4%') AS d, count(*) FILTER (o_orderpriority LIKE '5%') AS e FROM orders GROUP BY o_custkey)
SELECT CAST(o_custkey AS VARCHAR) AS job_id, CAST(greatest(0, least(100, 100 - 25 * a - 14 * b - 7 * c - 3 * d - e)) AS INT) AS security, CAST(greatest(0, least(100, 100 - 3 * a - 12 * b - 6 * c - 2 * d - 3 * e)) AS INT) AS performance FROM g""")
def _(spark, sf_dir):
    """Orders as findings of customers: priorities as severities."""
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    x = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("job_id"), F.element_at(F.array(*[F.lit(s) for s in V.SEVERITIES]), p).alias("severity"))
    return scoring.severity_counts(x).select("job_id", scoring.clamp(scoring.penalised(V.PENALTY)).alias("security"), scoring.clamp(scoring.penalised(V.PERFORMANCE_PENALTY)).alias("performance"))


@_query("SCO7_SCO8_documentation", f"""WITH f AS ({_LANG}), a AS (SELECT job_id, path, language, language NOT IN ({_quote(V.NOT_CODE)}) AS code, list_filter(list_transform(string_split(source, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM f)
SELECT job_id, bool_or(lower(path) IN ('readme.md', 'readme.rst', 'readme.txt')) AS readme, count(*) FILTER (language = 'markdown') AS docs, CAST(sum(CASE WHEN code THEN len(l) ELSE 0 END) AS BIGINT) AS code_lines,
CAST(sum(CASE WHEN code THEN len(list_filter(l, lambda s: regexp_matches(s, '^(#|//|\\*|/\\*|\"\"\"|'''''')'))) ELSE 0 END) AS BIGINT) AS comment_lines, count(*) FILTER (regexp_matches(path, '{V.TEST_PATH}')) AS test_files, count(*) FILTER (code) AS code_files FROM a GROUP BY job_id""", "code_files")
def _(spark, sf_dir):
    return scoring.documentation_facts(_files(spark, sf_dir))


# --- diagrams ----------------------------------------------------------------


@_query("DIA1_cap", """WITH n AS (SELECT 'job' || CAST(o_custkey % 3 AS VARCHAR) AS job_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) AS position FROM orders) SELECT job_id, CAST(o_orderkey AS VARCHAR) AS id, CAST(position AS INT) AS position FROM n WHERE position <= 300""")
def _(spark, sf_dir):
    x = _table(spark, sf_dir, "orders").select(F.concat(F.lit("job"), (F.col("o_custkey") % 3).cast("string")).alias("job_id"), "o_orderkey")
    n = diagrams._node(x, "d", F.col("o_orderkey").cast("string"), "t", "l", diagrams._o(F.col("o_orderkey")))
    return diagrams.cap(n, diagrams._edge(x, "d", F.col("o_orderkey").cast("string"), F.col("o_orderkey").cast("string"), "", "t", diagrams._o(0)))[0].select("job_id", "id", "position")


@_query("DIA3_DIA4_package_dependency", f"WITH {_RESOLVED}, e AS (SELECT job_id, coalesce(target, 'external::' || {_ROOT}) AS target FROM r) SELECT job_id, target, count(*) AS importers FROM e WHERE starts_with(target, 'external::') GROUP BY ALL", "imports", "web_files")
def _(spark, sf_dir):
    e = graph.import_edges(frame(spark, sf_dir, "imports"), frame(spark, sf_dir, "web_files"))
    _, edges = diagrams.package_dependency(frame(spark, sf_dir, "web_files"), e)
    return edges.select("job_id", "target", F.regexp_extract("label", r"^(\d+)", 1).cast("long").alias("importers"))


@_query("DIA7_components", f"""WITH {_RESOLVED}, e AS (SELECT job_id, regexp_extract(path, '^([^/]*/[^/]*)/', 1) AS u, regexp_extract(target, '^([^/]*/[^/]*)/', 1) AS v FROM r WHERE target IS NOT NULL) SELECT job_id, u, v, count(*) AS weight FROM e WHERE u <> v GROUP BY ALL""", "imports", "web_files")
def _(spark, sf_dir):
    e = graph.import_edges(frame(spark, sf_dir, "imports"), frame(spark, sf_dir, "web_files"))
    return diagrams.component_edges(e, 2).select("job_id", "u", "v", "weight")


@_query("DIA13_handlers", """WITH e AS (SELECT event_id, user_id % 50 AS f, event_id % 3 AS j, CAST(event_id % 400 AS INT) AS line FROM events), x AS (SELECT e.event_id, f.name, f.parent_class, f.sym_seq, abs(f.start_line - e.line) AS gap, f.start_line <= e.line AND e.line <= f.end_line + 5 AS inside FROM e JOIN functions f ON f.job_id = 'job' || e.j AND f.file_seq = e.f)
SELECT event_id, name, parent_class FROM x WHERE inside OR gap <= 3 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY NOT inside, gap, sym_seq) = 1""", "functions")
def _(spark, sf_dir):
    """Events as endpoints, each at a line of a file."""
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("job"), (F.col("event_id") % 3).cast("string")).alias("job_id"), F.concat(F.lit("app/s"), (F.col("user_id") % 50).cast("string"), F.lit(".py")).alias("file"), F.lit("GET").alias("method"), F.lit("/").alias("path"), (F.col("event_id") % 400).cast("int").alias("line"), F.col("event_id").alias("flow"))
    return diagrams.handlers(e, frame(spark, sf_dir, "functions")).select(F.col("flow").alias("event_id"), "name", "parent_class")


# --- retrieval, jobs ---------------------------------------------------------


@_query("RAG1_RAG3_windows", """WITH a AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l0 FROM documents), b AS (SELECT doc_id, CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END AS l FROM a),
c AS (SELECT doc_id, l, unnest(generate_series(0, greatest(0, CAST(ceil((len(l) - 10) / 2.0) AS INT)), 1)) AS i FROM b WHERE len(l) > 0), d AS (SELECT doc_id, i, len(l) AS n, array_to_string(l[i * 2 + 1:i * 2 + 10], chr(10)) AS t FROM c)
SELECT doc_id, CAST(i * 2 + 1 AS INT) AS start_line, CAST(least(i * 2 + 10, n) AS INT) AS end_line, md5(CASE WHEN length(t) > 2500 THEN substr(t, 1, 2500) || chr(10) || '... (truncated)' ELSE t END) AS text_md5 FROM d WHERE trim(t, chr(32) || chr(10) || chr(9)) <> ''""")
def _(spark, sf_dir):
    """Windows of ten lines, eight of them shared, over documents."""
    x = _table(spark, sf_dir, "documents").select(F.lit("j").alias("job_id"), F.col("doc_id").alias("file_seq"), F.lit("a").alias("path"), F.coalesce("text", F.lit("")).alias("source"))
    return retrieval.window_chunks(x, 10, 8).select(F.col("file_seq").alias("doc_id"), "start_line", F.col("end_line").cast("int").alias("end_line"), F.md5("text").alias("text_md5"))


@_query("RAG6_nearest", "WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)) AS s FROM embeddings, q) SELECT vec_id FROM d ORDER BY s, vec_id LIMIT 6")
def _(spark, sf_dir):
    """The six vectors nearest to the first one."""
    v = _table(spark, sf_dir, "embeddings")
    return retrieval.nearest(v, v.orderBy("vec_id").first().embedding, tie="vec_id").select("vec_id")


# --- without SQL -------------------------------------------------------------


def _parsed(spark, sf_dir):
    return parsing.parse_files(frame(spark, sf_dir, "sources").withColumn("loc", F.size(T.lines("source"))).withColumn("size_bytes", F.octet_length("source").cast("long")))


def _code_once(spark, sf_dir):
    """The parsed sources, written and read again: each table of Code would parse them anew."""
    parsed, path = _parsed(spark, sf_dir), f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}"
    parsed.write.parquet(path)
    return parsing.Code(spark.read.schema(parsed.schema).parquet(path))


@_query("PAR3_parse", "SELECT job_id, path, 'function' AS kind, 'f' AS name, 3 AS start_line, 3 AS end_line FROM sources WHERE file_seq % 5 <> 0", "sources")
def _(spark, sf_dir):
    return parsing.Code(_parsed(spark, sf_dir)).symbols.select("job_id", "path", "kind", "name", "start_line", "end_line")


# --- over parsed sources and bodies ------------------------------------------


@_query("GRA1_GRA2_nodes", "SELECT job_id, path AS id, 'file' AS type, CAST(NULL AS VARCHAR) AS name FROM sources UNION ALL SELECT job_id, path || '::f', 'function', 'f' FROM sources WHERE file_seq % 5 <> 0", "sources")
def _(spark, sf_dir):
    return graph.nodes(_code_once(spark, sf_dir)).select("job_id", "id", "type", "name")


@_query("SRC16_graph_json", "SELECT job_id, path AS source, path || '::f' AS target, 'defines' AS type FROM sources WHERE file_seq % 5 <> 0", "sources")
def _(spark, sf_dir):
    """The graph as JSON, and back."""
    code = _code_once(spark, sf_dir)
    return graph.from_json(graph.to_json(graph.nodes(code), graph.edges(code)))[1].select("job_id", "source", "target", "type")


@_query("RAG2_symbol_chunks", "SELECT job_id, path AS file, 3 AS start_line, 3 AS end_line, 'f' AS symbol, 'def f(): pass' AS text FROM sources WHERE file_seq % 5 <> 0", "sources")
def _(spark, sf_dir):
    return retrieval.symbol_chunks(parsing.Code(_parsed(spark, sf_dir)).bodies).select("job_id", "file", "start_line", "end_line", "symbol", "text")


@_query("RAG7_CTL10_stored_source", "SELECT o_custkey, string_agg('// lines ' || o_orderkey || '-' || (o_orderkey + 1) || chr(10) || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    """A customer's orders as the stored chunks of a file."""
    x = _table(spark, sf_dir, "orders").select(F.lit("j").alias("job_id"), F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("start_line"), (F.col("o_orderkey") + 1).alias("end_line"), F.col("o_orderpriority").alias("text"))
    return retrieval.viewed(x).select(F.col("file").cast("long").alias("o_custkey"), "text")


@_query("DIA2_folder_tree", f"""WITH f AS ({_LANG}), a AS (SELECT job_id, path, string_split(path, '/') AS p FROM f), b AS (SELECT job_id, p, unnest(range(0, len(p))) AS d FROM a), c AS (SELECT DISTINCT job_id, p[1:d] AS p, 'dir' AS type FROM b UNION ALL SELECT job_id, p, 'file' FROM a),
k AS (SELECT *, CASE WHEN len(p) = 0 THEN '' ELSE array_to_string(list_transform(p, lambda s, i: CASE WHEN i = len(p) AND type = 'file' THEN chr(3) ELSE chr(2) END || s), chr(1)) END AS o FROM c)
SELECT job_id, array_to_string(p, '/') AS path, type, CAST(row_number() OVER (PARTITION BY job_id ORDER BY o) AS INT) AS position FROM k""", "code_files")
def _(spark, sf_dir):
    """Folders and files in the tree's order."""
    return summary.tree_rows(_files(spark, sf_dir)).select("job_id", "path", "type", "position")


@_query("DIA9_api_flow", f"""WITH {_ENDS}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CAST(regexp_extract(file, 'x(\\d+)', 1) AS BIGINT), line) - 1 AS i FROM e)
SELECT job_id, 'client->endpoint::' || i AS id, 'endpoint::' || i AS target FROM n UNION ALL SELECT job_id, 'endpoint::' || i || '->file::' || file || ':line ' || line, 'file::' || file FROM n""", "sources")
def _(spark, sf_dir):
    s = frame(spark, sf_dir, "sources")
    e = api_surface.endpoints(s)
    # in the order of lines: a file's patterns are matched one after the other
    return diagrams.api_flow(s.select("job_id").distinct(), e.withColumn("seq", F.col("line")))[1].select("job_id", "id", "target")


@_query("DIA15_data_flow", """WITH p AS (SELECT job_id, bool_or(path LIKE '%/controllers/%') AS c, bool_or(path LIKE '%/services/%') AS s, bool_or(path LIKE '%/models/%') AS m FROM code_files GROUP BY job_id),
l AS (SELECT job_id, ['client'] || CASE WHEN c THEN ['input'] ELSE [] END || CASE WHEN s THEN ['business'] ELSE [] END || CASE WHEN m THEN ['data'] ELSE [] END AS l FROM p), q AS (SELECT job_id, CASE WHEN len(l) = 1 THEN l || ['app'] ELSE l END AS l FROM l)
SELECT job_id, unnest(l[:-2]) AS source, unnest(l[2:]) AS target FROM q""", "code_files")
def _(spark, sf_dir):
    none = spark.createDataFrame([], "job_id string, name string")
    return diagrams.data_flow(_files(spark, sf_dir), none)[1].select("job_id", "source", "target")


@_query("DIA10_DIA11_deployment", "SELECT CAST(p_partkey AS VARCHAR) AS job_id, 'web' || p_size AS source, 'db' AS target FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'client', 'app' FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf_dir):
    """A compose file for two parts in three, whose lists take turns in style."""
    p = _table(spark, sf_dir, "part")
    deps = F.when(F.col("p_partkey") % 3 == 1, F.lit("    depends_on: [db, gone]")).otherwise(F.lit("    depends_on:\n      - db\n      - gone"))
    text = F.concat(F.lit("version: '3'\nservices:\n  web"), F.col("p_size").cast("string"), F.lit(":\n    image: w\n"), deps, F.lit("\n  db:\n    image: pg\nvolumes:\n  x:\n"))
    s = p.select(F.col("p_partkey").cast("string").alias("job_id"), F.lit(1).alias("file_seq"), F.when(F.col("p_partkey") % 3 == 0, "x.yml").otherwise("deploy/docker-compose.yml").alias("path"), text.alias("source"))
    none = spark.createDataFrame([], "job_id string, orm string")
    _, e = diagrams.deployment(s.select("job_id"), s, none, none)
    return e.select("job_id", "source", "target")


def _body_rows(spark, sf_dir, language: str, name: F.Column, lines: F.Column, bases: list[str], decorators: list[str]) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select(F.lit("j").alias("job_id"), F.col("p_partkey").alias("file_seq"), F.col("p_partkey").cast("string").alias("path"), F.lit(language).alias("language"), F.lit(0).alias("sym_seq"), F.lit("class").alias("kind"), name.alias("name"), F.array(*[F.lit(b) for b in bases]).cast("array<string>").alias("base_classes"), F.array(*[F.lit(d) for d in decorators]).cast("array<string>").alias("decorators"), F.split(lines, "\n").alias("body"), F.array(F.lit("T")).alias("db_sets"))


@_query("DB1_DB2_DB3_python_models", """SELECT 't' || p_partkey AS name, 'sqlalchemy' AS orm, 'id:Integer:true:-,owner:db.String:false:t' || p_size || ',plain:unknown:false:-' AS columns FROM part
UNION ALL SELECT 'M', 'django', 'id:AutoField:true:-,owner:ForeignKey:false:P' || p_size || ',n:IntegerField:true:-' FROM part""")
def _(spark, sf_dir):
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    a = F.concat(F.lit('class A:\n  __tablename__ = "t'), k, F.lit('"\n  id: Mapped[int] = mapped_column(Integer)\n  owner = Column(db.String, ForeignKey("t'), z, F.lit('"))\n  x = 1\n  plain = db.Column("p")'))
    b = F.concat(F.lit("class M(models.Model):\n  owner = models.ForeignKey('P"), z, F.lit("', x)\n  n = models.IntegerField(primary_key=True)\n  y = 2"))
    t = database.sqlalchemy_models(_body_rows(spark, sf_dir, "python", F.lit("A"), a, ["Base"], [])).unionByName(database.django_models(_body_rows(spark, sf_dir, "python", F.lit("M"), b, ["models", "Model"], [])))
    return t.select("name", "orm", F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"], c["primary_key"].cast("string"), F.coalesce(c["foreign_key"], F.lit("-")))), ",").alias("columns"))


@_query("DB4_DB5_DB6_DB7_entities", """SELECT 'T' AS name, o AS orm, CASE o WHEN 'typeorm' THEN 'id:number:true:-,own:X' || p_size || ':false:X' || p_size WHEN 'hibernate/jpa' THEN 'id:Long:true:-,own:X' || p_size || ':false:X' || p_size ELSE 'K:int:true:-,Own:X' || p_size || ':false:X' || p_size END AS columns FROM part, (VALUES ('typeorm'), ('hibernate/jpa'), ('entity framework')) AS v(o)""")
def _(spark, sf_dir):
    z = F.col("p_size").cast("string")
    bodies = (
        ("typescript", F.concat(F.lit("class T {\n  @PrimaryColumn()\n  id: number;\n  @ManyToOne(x)\n  // note\n\n  own: X"), z, F.lit(";\n  @Column()\n  call();\n  z: string;\n}")), ["@Entity()"]),
        ("java", F.concat(F.lit("class T {\n  @Id\n  private Long id;\n  @ManyToOne\n  private X"), z, F.lit(" own;\n  private int z;\n}")), ["@Entity"]),
        ("csharp", F.concat(F.lit("class T {\n  [Key]\n  public int K { get; }\n  [ForeignKey]\n  public virtual X"), z, F.lit(" Own { get; }\n  public int Z { get; }\n}")), []),
    )
    x = None
    for language, text, decorators in bodies:
        y = _body_rows(spark, sf_dir, language, F.lit("T"), text, [], decorators)
        x = y if x is None else x.unionByName(y)
    t = database.decorated_entities(x)
    return t.select("name", "orm", F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"], c["primary_key"].cast("string"), F.coalesce(c["foreign_key"], F.lit("-")))), ",").alias("columns"))


@_query("DB8_DB9_mongoose", "SELECT 'M' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'a:mixed,b:mixed' ELSE 'a:String,b:Number' END AS columns FROM part")
def _(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    fields = F.when(F.col("p_partkey") % 2 == 0, "a: { type: String }, b: { x: 1 }").otherwise("a: String, b: Number")
    s = p.select(F.lit("j").alias("job_id"), F.col("p_partkey").alias("file_seq"), F.lit("m.js").alias("path"), F.lit("javascript").alias("language"), F.concat(F.lit("const M"), F.col("p_partkey").cast("string"), F.lit("Schema = new mongoose.Schema({ "), fields, F.lit(" }); x = { c: { d: 1 } }")).alias("source"))
    return database.mongoose_schemas(s).select("name", F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"])), ",").alias("columns"))


@_query("SOL3_stub_overrides", "SELECT CAST(p_partkey AS VARCHAR) AS file, 'B.m' AS symbol FROM part WHERE p_partkey % 3 < 2")
def _(spark, sf_dir):
    """Class B overrides a method of class A: with a stub in two parts of three."""
    # Few bytes make many files: as when files are parsed, every core takes part.
    p = _table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    rest = F.element_at(F.array(F.lit("    raise NotImplementedError"), F.lit("    pass"), F.lit("    return 1")), (F.col("p_partkey") % 3 + 1).cast("int"))
    row = lambda i, kind, name, parent, bases, start, end: F.struct(F.lit(i).alias("sym_seq"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(parent).cast("string").alias("parent_class"), F.array(*[F.lit(b) for b in bases]).cast("array<string>").alias("base_classes"), F.lit(start).alias("start_line"), F.lit(end).alias("end_line"))
    symbols = F.array(row(0, "class", "A", None, [], 1, 3), row(1, "method", "m", "A", [], 2, 3), row(2, "class", "B", None, ["x.A"], 4, 9), row(3, "method", "m", "B", [], 5, 7), row(4, "method", "own", "B", [], 8, 9))
    source = F.concat(F.lit("class A:\n  def m\n    return 0\nclass B(x.A):\n  def m\n\n"), rest, F.lit("\n  def own\n    pass"))
    x = p.select(F.lit("j").alias("job_id"), F.col("p_partkey").alias("file_seq"), F.col("p_partkey").cast("string").alias("path"), source.alias("source"), symbols.alias("symbols"))
    return design.lsp(x).select("file", "symbol")


@_query("PAT12_injection", "SELECT job_id, path AS file, CAST(NULL AS VARCHAR) AS symbol, 0 AS line FROM sources WHERE contains(source, '@login_required')", "sources")
def _(spark, sf_dir):
    x = frame(spark, sf_dir, "sources").withColumn("source", F.replace("source", F.lit("@login_required"), F.lit("@Injectable()")))
    return design.injections(x).select("job_id", "file", "symbol", "line")


@_query("PAR17_PAR18_PAR19_ecosystem", """SELECT CAST(p_partkey AS VARCHAR) AS job_id, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'react,vue' WHEN 1 THEN 'django,flask' WHEN 2 THEN 'spring boot' WHEN 3 THEN 'laravel,symfony' WHEN 4 THEN 'rails' ELSE '' END AS frameworks,
CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'npm/yarn/pnpm' WHEN 1 THEN 'poetry/pip' WHEN 2 THEN 'maven' WHEN 3 THEN 'composer' WHEN 4 THEN 'bundler' ELSE 'go modules' END AS managers FROM part""")
def _(spark, sf_dir):
    """Each part a repository with one manifest."""
    files = (
        ("package.json", '{"dependencies": {"react": "1", "left": "2"}, "devDependencies": {"vue": "3"}}'), ("pyproject.toml", '[project]\ndependencies = ["Flask>=1"]\n[tool.poetry.dependencies]\nDjango = "4"\n'), ("pom.xml", "<a>Spring-Boot</a>"),
        ("composer.json", '{"require": {"laravel/framework": "1"}, "require-dev": {"symfony/x": "2"}}'), ("Gemfile", "gem 'Rails'"), ("go.mod", "module x"),
    )
    at = (F.col("p_partkey") % 6 + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in files]), at)
    s = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("job_id"), F.lit(1).alias("file_seq"), F.concat(F.lit("sub/"), pick(0)).alias("path"), pick(1).alias("source"))
    return ecosystem.detect_ecosystem(s).select("job_id", F.array_join("frameworks", ",").alias("frameworks"), F.array_join("package_managers", ",").alias("managers"))


@_query("FE1_FE2_score_bands", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(o_orderkey % 101 AS INT) AS score, CASE WHEN o_orderkey % 101 >= 80 THEN 'good' WHEN o_orderkey % 101 >= 60 THEN 'fair' ELSE 'poor' END AS band FROM orders WHERE o_custkey % 2 = 0")
def _(spark, sf_dir):
    x = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.when(F.col("o_custkey") % 2 == 0, "security").otherwise("overall").alias("name"), (F.col("o_orderkey") % 101).cast("int").alias("score"))
    return scoring.bands(x).select("job_id", "score", "band")


from . import cases, checks  # noqa: E402, F401  (add their queries)
