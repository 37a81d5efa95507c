"""The jobs as queries over the whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import audit_stream, clone_report
from jobs._common import NO_SOURCE
from lithoscope.functions import values as V
from lithoscope.plans import registry as R
from lithoscope.sources.store import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings after two runs into one folder, of which the second finds nothing new,
    and how many documents (seq) and lines (message) of each source were scanned."""
    to = _folder(spark, "audit")
    for _ in range(2):
        audit_stream.run(spark, f"{sf_dir}/documents.parquet", f"{to}/tables", f"{to}/checkpoint")
    found = audit_stream.read(spark, f"{to}/tables").drop("batch")
    totals = audit_stream.scanned(spark, f"{to}/tables").groupBy("source").agg(F.sum("documents").alias("seq"), F.sum("lines").cast("string").alias("message"))
    return found.unionByName(totals.withColumns({"category": F.lit("scanned"), "severity": F.lit("info")}), allowMissingColumns=True)


def job2_clone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables after two runs into one folder, a source's totals as a row without a doc_id."""
    to = _folder(spark, "clones")
    for _ in range(2):
        clone_report.run(spark, f"{sf_dir}/documents.parquet", to)
    n = lambda c: F.col(c).cast("long")
    rows = clone_report.read(spark, to).select("source", "doc_id", n("start_line").alias("start_line"), n("end_line").alias("end_line"), "holders", "repositories", "first_doc")
    totals = clone_report.sources(spark, to).select("source", F.lit(None).cast("long").alias("doc_id"), F.col("documents").alias("start_line"), F.col("lines").alias("end_line"), F.col("copied_documents").alias("holders"), F.col("copied_lines").alias("repositories"), F.col("borrowed_lines").alias("first_doc"))
    return rows.unionByName(totals)


_SOURCE = f"coalesce(nullif(source, ''), '{NO_SOURCE}')"
_ENDS = r"'\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]'"
_LINES = f"SELECT doc_id, {_SOURCE} AS source, regexp_split_to_array(coalesce(text, ''), {_ENDS}) AS l FROM documents"


def _rows(where: str, seq: int, category: str, severity: str, message: str, table: str = "t") -> str:
    return f"SELECT source, doc_id, line, {seq} AS seq, '{category}' AS category, '{severity}' AS severity, {message} AS message FROM {table} WHERE {where}"


_named = audit_stream.assigned(audit_stream.SECRET_NAMES).replace("'", "''")
_AUDIT = f"""WITH a AS ({_LINES}), t AS (SELECT source, doc_id, unnest(l) AS text, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line FROM a), s AS (SELECT * FROM t WHERE {R._env}),
k AS (SELECT source, doc_id, line, unnest(regexp_extract_all(text, '{R._secret}', 1, 'i')) AS k, unnest(regexp_extract_all(text, '{R._secret}', 2, 'i')) AS v, unnest(range(len(regexp_extract_all(text, '{R._secret}', 2, 'i')))) AS i FROM s),
m AS (SELECT source, doc_id, line, unnest(regexp_extract_all(text, '{_named}', 1, 'i')) AS k, unnest(regexp_extract_all(text, '{_named}', 2, 'i')) AS v, unnest(range(len(regexp_extract_all(text, '{_named}', 2, 'i')))) AS i FROM s),
d AS (SELECT *, {R._why} AS w FROM t)
SELECT source, doc_id, line, i AS seq, 'hardcoded_secret' AS category, 'critical' AS severity, 'possible hardcoded ' || k AS message FROM k WHERE NOT lower(v) IN ({R._quote(V.PLACEHOLDERS)}) AND NOT starts_with(v, '${{') AND NOT starts_with(v, '{{{{')
UNION ALL SELECT source, doc_id, line, 1000 + i, 'named_secret', 'critical', 'possible hardcoded ' || k FROM m WHERE NOT lower(v) IN ({R._quote(V.PLACEHOLDERS)}) AND NOT starts_with(v, '${{') AND NOT starts_with(v, '{{{{')
UNION ALL SELECT source, NULL, NULL, count(*), 'scanned', 'info', CAST(CAST(sum(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END) AS BIGINT) AS VARCHAR) FROM a GROUP BY source
UNION ALL {_rows(R._m(V.AWS_KEY), 900, "hardcoded_secret", "critical", "'AWS access key ID literal found'", "s")}
UNION ALL {_rows(R._m(V.PRIVATE_KEY), 901, "hardcoded_secret", "critical", "'private key material committed to source'", "s")}
UNION ALL {_rows(" OR ".join(R._m(p) for p in V.SQL_INJECTION), 910, "sql_injection", "high", "'user input may be interpolated directly into a SQL query — use parameterized queries'")}
UNION ALL {_rows("w IS NOT NULL", 920, "unsafe_deserialization", "high", "w", "d")}
UNION ALL {_rows(R._m(V.WEAK_HASH, "i") + " AND contains(lower(text), 'password')", 930, "weak_auth", "high", "'MD5/SHA1 is not suitable for password hashing — use bcrypt/argon2/scrypt'")}
UNION ALL {_rows(R._m(V.SENSITIVE_LOG, "i"), 940, "sensitive_log", "medium", "'log statement appears to include a sensitive value'")}"""

_STRIP = f"lambda s: regexp_replace(s, '^[{R._WS}]+|[{R._WS}]+$', '', 'g')"
_CLONES = f"""WITH a AS ({_LINES}), f AS (SELECT doc_id, source, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM a),
b AS (SELECT doc_id, source, list_transform(l, {_STRIP}) AS l FROM f),
c AS (SELECT doc_id, source, l, unnest(range(1, len(l) - 1)) AS line FROM b), d AS (SELECT doc_id, source, line, l[line:line + 2] AS w FROM c),
e AS (SELECT DISTINCT doc_id, source, line, array_to_string(w, chr(10)) AS t FROM d WHERE len(list_filter(w, lambda s: s <> '')) >= 2),
h AS (SELECT t, count(DISTINCT (source, doc_id)) AS holders, count(DISTINCT source) AS repositories, min(doc_id) AS first_doc FROM e WHERE length(t) >= 40 GROUP BY t HAVING count(DISTINCT (source, doc_id)) >= 2),
g AS (SELECT e.*, holders, repositories, first_doc, CASE WHEN line > coalesce(lag(line) OVER (PARTITION BY source, doc_id ORDER BY line), -3) + 3 THEN 1 ELSE 0 END AS gap FROM e JOIN h USING (t)),
i AS (SELECT *, sum(gap) OVER (PARTITION BY source, doc_id ORDER BY line) AS passage FROM g),
p AS (SELECT source, doc_id, min(line) AS start_line, max(line) + 2 AS end_line, max(holders) AS holders, max(repositories) AS repositories, min(first_doc) AS first_doc FROM i GROUP BY source, doc_id, passage),
n AS (SELECT source, count(*) AS documents, CAST(sum(len(l)) AS BIGINT) AS lines FROM f GROUP BY source),
q AS (SELECT source, count(DISTINCT doc_id) AS docs, CAST(sum(end_line - start_line + 1) AS BIGINT) AS copied, CAST(sum(CASE WHEN first_doc <> doc_id THEN end_line - start_line + 1 ELSE 0 END) AS BIGINT) AS borrowed FROM p GROUP BY source)
SELECT source, doc_id, start_line, end_line, holders, repositories, first_doc FROM p
UNION ALL SELECT source, NULL, documents, lines, coalesce(docs, 0), coalesce(copied, 0), coalesce(borrowed, 0) FROM n LEFT JOIN q USING (source)"""

QUERIES = {f.__name__: f for f in (job1_audit_stream, job2_clone_report)}
ORACLE_SQL = {"job1_audit_stream": _AUDIT, "job2_clone_report": _CLONES}
