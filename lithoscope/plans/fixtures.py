"""Code-like tables made from the driver's tables.

Each is one SQL text that both engines understand, so that an operator here and its
SQL there start from the same rows.  {name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Lines of made-up code, one per order.
_TEXTS = (
    "'password = \"s' || CAST(o_orderkey AS STRING) || 'cret99\"'",
    "'api_key: \"' || CAST(o_custkey AS STRING) || 'abcdefgh\"'",
    "'secret = \"changeme\"'",
    "'token = os.environ[\"password\"]; password = \"' || CAST(o_orderkey AS STRING) || '12345678\"'",
    "'key = \"AKIA' || 'ABCDEFGHIJKLMNOP' || '\"  # ' || CAST(o_orderkey AS STRING)",
    "'-----BEGIN RSA PRIVATE KEY-----'",
    "'cur.execute(f\"select ' || CAST(o_orderkey AS STRING) || '\")'",
    "'cur.execute(\"select %s\" % x' || CAST(o_orderkey AS STRING) || ')'",
    "'db.query(\"select \" + name)'",
    "'cur.execute(\"select ?\", (x,))'",
    "'data = pickle.loads(blob' || CAST(o_orderkey AS STRING) || ')'",
    "'yaml.load(f, Loader=SafeLoader)'",
    "'yaml.load(f)'",
    "'x = eval(y)'",
    "'h = md5(user.password)'",
    "'h = sha1(user.name)'",
    "'logger.info(\"in\", password)'",
    "'print(\"done\")'",
    "'for row in rows:'",
    "'    items = Order.objects.filter(id=' || CAST(o_orderkey AS STRING) || ')'",
    "'async def f' || CAST(o_orderkey AS STRING) || '():'",
    "'    time.sleep(' || CAST(o_custkey AS STRING) || ')'",
    "'    requests.get(url)'",
    "'while True:'",
    "''",
    "'    # comment ' || CAST(o_orderkey AS STRING)",
    "'    total = total + price * 47'",
    "'    if item.kind == 3 and item.status == 4:'",
    "'return value'",
)
FIXTURES = {
    "code_lines": "SELECT 'job' || CAST(o_custkey % 5 AS STRING) AS job_id, CAST(o_custkey % 97 AS BIGINT) AS file_seq, 'src/m' || CAST(o_custkey % 97 AS STRING) || '.py' AS path, 'python' AS language, "
    "CAST(row_number() OVER (PARTITION BY o_custkey % 5, o_custkey % 97 ORDER BY o_orderkey) AS INT) AS line, CASE CAST(o_orderkey % 29 AS INT) "
    + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS))
    + " END AS text FROM {orders}",
    "code_files": "SELECT 'job' || CAST(doc_id % 3 AS STRING) AS job_id, doc_id AS file_seq, source || '/' || lang || '/' || CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN 'README.md' WHEN 1 THEN 'tests/test_' || CAST(doc_id AS STRING) || '.py' WHEN 2 THEN 'Dockerfile' "
    "WHEN 3 THEN 'services/a' || CAST(doc_id AS STRING) || '.ts' WHEN 4 THEN 'controllers/b' || CAST(doc_id AS STRING) || '.JAVA' WHEN 5 THEN 'package.json' WHEN 6 THEN 'c' || CAST(doc_id AS STRING) WHEN 7 THEN 'node_modules/d.js' WHEN 8 THEN 'e' || CAST(doc_id AS STRING) || '.min.js' "
    "WHEN 9 THEN '.env' ELSE 'models/f' || CAST(doc_id AS STRING) || '.py' END AS path, n_chars AS loc, coalesce(text, '') AS source FROM {documents}",
    "functions": "SELECT 'job' || CAST(l_suppkey % 3 AS STRING) AS job_id, l_suppkey % 50 AS file_seq, 'app/s' || CAST(l_suppkey % 50 AS STRING) || '.py' AS path, CAST(row_number() OVER (PARTITION BY l_suppkey % 3, l_suppkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS INT) AS sym_seq, "
    "CASE WHEN l_linenumber % 3 = 0 THEN 'function' ELSE 'method' END AS kind, CASE CAST(l_linenumber AS INT) WHEN 1 THEN 'find' WHEN 2 THEN 'save' WHEN 3 THEN 'make_' || CAST(l_partkey % 200 AS STRING) WHEN 4 THEN 'notify' WHEN 5 THEN 'build' WHEN 6 THEN 'main' ELSE 'handle' || CAST(l_partkey % 400 AS STRING) END AS name, "
    "CAST(l_partkey % 300 AS INT) + 1 AS start_line, CAST(l_partkey % 300 AS INT) + 1 + 2 * CAST(l_quantity AS INT) AS end_line, CAST(l_quantity AS INT) % 26 AS complexity, CAST(l_partkey % 7 AS INT) AS max_nesting_depth, CAST(l_orderkey % 4 AS INT) AS max_loop_nesting, "
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'K' || CAST(l_partkey % 13 AS STRING) || CASE CAST(l_partkey % 13 AS INT) WHEN 0 THEN 'Repository' WHEN 1 THEN 'Builder' WHEN 2 THEN 'Command' ELSE 'X' END END AS parent_class, "
    "split(CASE WHEN l_orderkey % 3 = 0 THEN 'a.make_' || CAST(l_suppkey % 250 AS STRING) || ',K4X,self.x' ELSE 'make_' || CAST(l_orderkey % 250 AS STRING) || ',handle' || CAST(l_partkey % 500 AS STRING) END, ',') AS calls FROM {lineitem}",
    "classes": "SELECT 'job' || CAST(p_partkey % 3 AS STRING) AS job_id, p_partkey % 50 AS file_seq, 'app/s' || CAST(p_partkey % 50 AS STRING) || '.py' AS path, CAST(p_partkey AS INT) AS sym_seq, 'class' AS kind, CASE WHEN p_partkey % 29 = 0 THEN 'Base' || CAST(p_partkey % 40 AS STRING) WHEN p_partkey % 7 < 5 THEN 'K' || CAST(p_partkey % 13 AS STRING) || CASE CAST(p_partkey % 13 AS INT) WHEN 0 THEN 'Repository' WHEN 1 THEN 'Builder' WHEN 2 THEN 'Command' ELSE 'X' END "
    "ELSE CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'Factory' WHEN 1 THEN 'Strategy' WHEN 2 THEN 'Adapter' WHEN 3 THEN 'Facade' WHEN 4 THEN 'Listener' WHEN 5 THEN 'Decorator' WHEN 6 THEN 'GetQuery' WHEN 7 THEN 'DoHandler' ELSE 'IThing' END END AS name, "
    "CAST(p_size AS INT) AS start_line, CAST(p_size AS INT) + CAST(p_partkey % 500 AS INT) AS end_line, split('Base' || CAST(p_partkey % 40 AS STRING) || ',app.K' || CAST(p_partkey % 17 AS STRING) || 'X', ',') AS base_classes FROM {part}",
    "imports": "SELECT 'job' || CAST(o_orderkey % 3 AS STRING) AS job_id, o_custkey % 60 AS file_seq, 'web/d' || CAST(o_custkey % 6 AS STRING) || '/f' || CAST(o_custkey % 60 AS STRING) || '.ts' AS path, CAST(row_number() OVER (PARTITION BY o_orderkey % 3, o_custkey % 60 ORDER BY o_orderkey) AS INT) AS imp_seq, "
    "CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN './f' || CAST(o_custkey % 70 AS STRING) WHEN 1 THEN '../d' || CAST(o_orderkey % 7 AS STRING) || '/f' || CAST(o_orderkey % 60 AS STRING) WHEN 2 THEN '@scope/p' || CAST(o_custkey % 9 AS STRING) || '/x' WHEN 3 THEN 'react' WHEN 4 THEN 'os.path' WHEN 5 THEN 'kafka' WHEN 6 THEN 'a/b/F' || CAST(o_orderkey % 60 AS STRING) ELSE 'lib' || CAST(o_custkey % 30 AS STRING) || '.core' END AS raw FROM {orders}",
    "web_files": "SELECT DISTINCT 'job' || CAST(o_orderkey % 3 AS STRING) AS job_id, o_custkey % 60 AS file_seq, 'web/d' || CAST(o_custkey % 6 AS STRING) || '/f' || CAST(o_custkey % 60 AS STRING) || '.ts' AS path, 'typescript' AS language FROM {orders} WHERE o_custkey % 60 < 55",
    "sources": "SELECT 'job' || CAST(p_partkey % 4 AS STRING) AS job_id, p_partkey AS file_seq, 'r/x' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN '.prisma' ELSE '.py' END AS path, CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'python' END AS language, "
    "CASE WHEN p_partkey % 5 = 0 THEN 'model M' || CAST(p_partkey AS STRING) || ' ' || chr(123) || chr(10) || '  id Int @id' || chr(10) || '  // note' || chr(10) || '  owner M' || CAST(p_partkey + 20 AS STRING) || ' @relation(x)' || chr(10) || chr(125) "
    "ELSE '# head' || chr(10) || '@app.get(\"/p' || CAST(p_partkey AS STRING) || '\")' || chr(10) || 'def f(): pass' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'app.post( ''/q'', g)' || chr(10) || '@bp.route(\"/r\")' ELSE '@login_required' END END AS source FROM {part}",
}


def sql_of(name: str, spark: bool = False) -> str:
    text = FIXTURES[name]
    return text if spark else re.sub(r"\{(\w+)\}", r"\1", text)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture in Spark, over the whole of its table."""
    text = FIXTURES[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
