"""More queries of the engine's operators with their SQL: those that need rows made for
them.  MADE has those rows, as SQL that both engines understand ({name}: a table)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import api_surface, architecture, database, design, diagrams, findings, graph, parsing, retrieval, scoring, summary
from ..sources.store import JOBS, Store, shared_folder
from . import registry as R
from .fixtures import frame


def _files_of(rows: list[tuple[int, str]]) -> str:
    """Files of each part by p_partkey % 10."""
    return ", ".join(f"({k}, {i}, '{p}')" for i, (k, p) in enumerate(rows))


_STYLED = [
    (0, "src/ports/a.py"), (0, "src/adapters/b.py"), (1, "src/domain/a.py"), (1, "src/infra/b.py"), (2, "src/domain/a.py"), (2, "src/application/b.py"), (2, "src/infrastructure/c.py"),
    (3, "src/usecases/a.py"), (4, "a/package.json"), (4, "b/pom.xml"), (4, "a/Dockerfile"), (4, "b/Dockerfile"), (5, "serverless.yml"), (5, "handler.py"), (6, "app/consumers/a.py"),
    (7, "app/controllers/a.py"), (7, "app/services/b.py"), (7, "app/dao/c.py"), (8, "app/models/a.py"), (8, "app/views/b.py"), (8, "app/controllers/c.py"), (9, "main.py"),
]
_UPTO = lambda n: ", ".join(f"({i})" for i in range(1, n + 1))
_PART = "CAST(p_partkey AS STRING) AS job_id"
MADE = {
    "styled_files": f"SELECT {_PART}, CAST(v.i AS BIGINT) AS file_seq, v.path AS path FROM {{part}} JOIN (VALUES {_files_of(_STYLED)}) AS v(k, i, path) ON p_partkey % 10 = v.k",
    # up to six findings a part
    "marks": f"SELECT {_PART}, v.i AS i, CASE CAST((p_partkey + v.i) % 5 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, "
    "CASE CAST((p_size + v.i) % 4 AS INT) WHEN 0 THEN 'magic_number' WHEN 1 THEN 'deep_nesting' WHEN 2 THEN 'long_method' ELSE 'dead_code' END AS quality, "
    "CASE CAST((p_size + v.i) % 5 AS INT) WHEN 0 THEN 'n_plus_one_query' WHEN 1 THEN 'expensive_loop' WHEN 2 THEN 'blocking_call' ELSE 'missing_cache' END AS performance, "
    "CASE WHEN (p_partkey + p_size + v.i) % 3 = 0 THEN 'DIP' ELSE 'SRP' END AS principle "
    f"FROM {{part}} JOIN (VALUES {_UPTO(6)}) AS v(i) ON v.i <= p_size % 7",
    # two to four files a part: code with comments, a test, a README, a document
    "scored_files": f"SELECT {_PART}, CAST(v.i AS BIGINT) AS file_seq, CASE v.i WHEN 1 THEN 'app/a.py' WHEN 2 THEN 'app/b.py' WHEN 3 THEN 'tests/test_a.py' WHEN 4 THEN 'README.md' ELSE 'docs/x.md' END AS path, "
    "CASE WHEN v.i <= 3 THEN 'python' ELSE 'markdown' END AS language, CASE WHEN v.i <= 3 THEN repeat('# note' || chr(10), CAST(p_partkey % 4 AS INT)) || repeat('x = 1' || chr(10) || chr(10), CAST(p_size % 5 AS INT) + 1) ELSE 'text' END AS source "
    f"FROM {{part}} JOIN (VALUES {_UPTO(5)}) AS v(i) ON v.i <= 2 OR (v.i = 3 AND p_partkey % 2 = 0) OR (v.i = 4 AND p_partkey % 3 = 0) OR (v.i = 5 AND p_partkey % 5 = 0)",
}


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = set(re.findall(r"\{(\w+)\}", MADE[name]))
    return spark.sql(MADE[name], **{t: R._table(spark, sf_dir, t) for t in tables})


def _query(name: str, sql: str, *fixtures: str):
    """As in the registry; fixtures may be MADE ones."""
    own = [f for f in fixtures if f in MADE]
    head = ", ".join(f"{f} AS ({re.sub(r'[{](\w+)[}]', r'\1', MADE[f])})" for f in own)
    if head:
        body = sql.strip()
        sql = f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
    return R._query(name, sql, *[f for f in fixtures if f not in MADE])


# --- jobs, folders -----------------------------------------------------------


@_query("SRC17_SRC18_recent_jobs", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'done' AS status FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 100")
def _(spark, sf_dir):
    """Orders as jobs with two status rows each, of which the latest counts."""
    x = R._table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit("n").alias("name"), F.lit("local").alias("source_type"), F.lit("r").alias("source_ref"), F.explode(F.array(F.lit("running"), F.lit("done"))).alias("status"), F.lit("done").alias("stage"), F.lit(100).alias("progress"), F.lit("").alias("message"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    rows = x.withColumn("seq", (F.col("status") == "done").cast("long"))
    store = Store(spark, f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}")
    rows.select(*[c.split()[0] for c in JOBS.split(", ")]).write.parquet(store.path("jobs"))
    return store.recent().select("job_id", "status")


_TREE = R.ORACLE_SQL["DIA2_folder_tree"]


@_query("DIA2_folder_diagram", f"SELECT job_id, CASE path WHEN '' THEN '/' ELSE path END AS id, CASE type WHEN 'dir' THEN 'folderNode' ELSE 'fileNode' END AS type, CASE path WHEN '' THEN '/' ELSE regexp_extract(path, '[^/]*$') END AS label FROM ({_TREE})")
def _(spark, sf_dir):
    return diagrams.folder_tree(summary.tree_rows(R._files(spark, sf_dir)))[0].select("job_id", "id", "type", "label")


@_query("DIA2_folder_edges", f"SELECT job_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '/' END AS source, path AS target FROM ({_TREE}) WHERE path <> ''")
def _(spark, sf_dir):
    return diagrams.folder_tree(summary.tree_rows(R._files(spark, sf_dir)))[1].select("job_id", "source", "target")


# --- findings ----------------------------------------------------------------

_SECURITY = ("SEC1_SEC2_secrets", "SEC3_sql_injection", "SEC4_unsafe_deserialization", "SEC5_weak_auth", "SEC6_sensitive_log")


@_query("SEC0_summary", "SELECT job_id, 'security' AS analyzer, category, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT job_id, category FROM ({R.ORACLE_SQL[n]})" for n in _SECURITY) + ") GROUP BY ALL")
def _(spark, sf_dir):
    return findings.by_category(findings.analyze_security(frame(spark, sf_dir, "code_lines")))


@_query("QUA6_magic_numbers", f"""WITH a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
b AS (SELECT * FROM a WHERE NOT regexp_matches(t, '^[\\s\\p{{Z}}]*(#|//|\\*|/\\*|$)') AND NOT regexp_matches(t, '{V.CONST_LINE}')),
c AS (SELECT doc_id, i, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_.]+') AS ws FROM b WHERE regexp_matches(t, '[0-9]')),
d AS (SELECT doc_id, i, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM c),
e AS (SELECT doc_id, i, p, coalesce(nullif(regexp_extract(w, '^([0-9]{{2,}})(\\..*)?$', 1), ''), nullif(regexp_extract(w, '^([0-9]\\.[0-9]+)(\\..*)?$', 1), '')) AS number FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, p) AS r FROM e WHERE number IS NOT NULL AND number NOT IN ({R._quote(V.PLAIN_NUMBERS)}))
SELECT doc_id, CAST(i + 1 AS INT) AS line, number FROM f WHERE r <= 5""")
def _(spark, sf_dir):
    """Numbers that are not plain ones, five a document at most, each the body of a function."""
    x = R._table(spark, sf_dir, "documents").select(F.lit("j").alias("job_id"), F.col("doc_id").alias("file_seq"), F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("sym_seq"), F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit(1).alias("start_line"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("body"))
    return findings.magic_numbers(x).select(F.col("file_seq").alias("doc_id"), "line", F.regexp_extract("message", r"number (\S+) in", 1).alias("number"))


# --- architecture ------------------------------------------------------------

_VERDICTS = [
    (0, "Hexagonal", 57, "ports/adapters folders present"), (1, "Hexagonal", 43, "domain + infrastructure separation"), (2, "Clean Architecture", 67, "domain/application/infrastructure layering"), (3, "Clean Architecture", 33, "usecases folder present"),
    (4, "Microservices", 78, "multiple top-level sub-projects with their own manifest; multiple Dockerfiles at different paths"), (5, "Serverless", 67, "serverless.yml present; handler-style entrypoint file(s)"), (6, "Event-Driven", 57, "producer/consumer or queue-oriented folders"),
    (7, "Layered", 100, "controller/service/repository layering; repository layer present"), (8, "MVC", 67, "models/views/controllers folders present"), (9, "Monolith", 100, "single top-level application, no service split; no deployment-topology signals found"),
]


@_query("ARC4_ARC5_all_styles", f"SELECT CAST(p_partkey AS VARCHAR) AS job_id, s AS primary_style, CAST(c AS INT) AS confidence, e AS evidence FROM part JOIN (VALUES {', '.join(map(repr, _VERDICTS))}) AS v(k, s, c, e) ON p_partkey % 10 = k")
def _(spark, sf_dir):
    """Each part a repository of one of ten kinds."""
    none = spark.createDataFrame([], "job_id string, raw string")
    x = architecture.detect_architecture(made(spark, sf_dir, "styled_files"), none)
    return x.select("job_id", "primary_style", "confidence", F.array_join("evidence", "; ").alias("evidence"))


# --- scores ------------------------------------------------------------------

_sum = lambda w, where="TRUE": "100 - coalesce(sum(CASE WHEN " + where + " THEN CASE severity " + " ".join(f"WHEN '{s}' THEN {w.get(s, 3)}" for s in V.SEVERITIES) + " END END), 0)"
_clamp = lambda x: f"greatest(0, least(100, {x}))"
_READ = "quality IN ('magic_number', 'deep_nesting', 'long_method')"
_SCORES = f"""WITH m AS (SELECT job_id, {_clamp(_sum(V.PENALTY))} AS security, {_clamp(_sum(V.PERFORMANCE_PENALTY))} AS performance, {_clamp(_sum(V.MAINTAIN_PENALTY))} AS maintain, {_clamp(_sum(V.READ_PENALTY, _READ))} AS reads,
  bool_or(performance = 'n_plus_one_query') AS np, bool_or(performance = 'expensive_loop') AS el, bool_or(performance = 'blocking_call') AS bc, count(*) AS n, count(*) FILTER (principle = 'DIP') AS dip FROM marks GROUP BY job_id),
f AS (SELECT job_id, bool_or(path = 'README.md') AS readme, count(*) FILTER (language = 'markdown') AS docs, count(*) FILTER (starts_with(path, 'tests/')) AS tests, count(*) FILTER (language = 'python') AS code,
  sum(CASE WHEN language = 'python' THEN len(list_filter(string_split(source, chr(10)), lambda s: s <> '')) ELSE 0 END) AS lines, sum(CASE WHEN language = 'python' THEN len(list_filter(string_split(source, chr(10)), lambda s: starts_with(s, '#'))) ELSE 0 END) AS comments FROM scored_files GROUP BY job_id),
p AS (SELECT CAST(p_partkey AS VARCHAR) AS job_id, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'Serverless' WHEN 1 THEN 'Monolith' ELSE 'MVC' END AS style, CAST(p_size AS INT) AS confidence, p_partkey % 12 AS average FROM part),
x AS (SELECT p.job_id, confidence AS architecture, coalesce(security, 100) AS security, coalesce(performance, 100) AS performance, {_clamp("coalesce(maintain, 100) - 3 * coalesce(n, 0)")} AS maintainability,
  CASE WHEN average > 8 THEN {_clamp("coalesce(reads, 100) - 10")} ELSE coalesce(reads, 100) END AS readability,
  {_clamp("CASE WHEN style = 'Serverless' THEN 70 ELSE 55 END - CASE WHEN np THEN 15 ELSE 0 END - CASE WHEN el THEN 10 ELSE 0 END - CASE WHEN bc THEN 10 ELSE 0 END")} AS scalability,
  {_clamp(_clamp("round_even(200.0 * tests / code, 0)") + " - 4 * coalesce(dip, 0)")} AS testability,
  {_clamp("CASE WHEN readme THEN 40 ELSE 10 END + least(30, 5 * docs) + least(30, round_even(CAST(comments AS DOUBLE) / lines * 150, 0))")} AS documentation FROM p JOIN f USING (job_id) LEFT JOIN m USING (job_id)),
y AS (SELECT *, {_clamp("round_even(0.0 + " + " + ".join(f"CAST({k} AS DOUBLE) * CAST({w} AS DOUBLE)" for k, w in V.SCORE_WEIGHTS.items()) + ", 0)")} AS overall FROM x)
SELECT job_id, unnest([{', '.join(f"'{k}'" for k in [*V.SCORE_WEIGHTS, 'overall'])}]) AS name, unnest([{', '.join(f'CAST({k} AS INT)' for k in [*V.SCORE_WEIGHTS, 'overall'])}]) AS score FROM y"""


@_query("SCO1_SCO9_scores", _SCORES, "marks", "scored_files")
def _(spark, sf_dir):
    """Each part a repository with a few findings and files."""
    m, p = made(spark, sf_dir, "marks"), R._table(spark, sf_dir, "part")
    job, k = F.col("p_partkey").cast("string").alias("job_id"), F.col("p_partkey") % 3
    style = p.select(job, F.when(k == 0, "Serverless").when(k == 1, "Monolith").otherwise("MVC").alias("primary_style"), F.col("p_size").cast("int").alias("confidence"), F.array(F.lit("e")).alias("evidence"))
    metrics = p.select(job, (F.col("p_partkey") % 12).cast("double").alias("average_complexity"))
    of = lambda c: m.select("job_id", F.col(c).alias("category"), "severity")
    x = scoring.compute_scores(made(spark, sf_dir, "scored_files"), style, of("quality"), metrics, of("quality"), of("performance"), m.select("job_id", "principle"))
    return x.select("job_id", "name", "score")


# --- patterns, SOLID ---------------------------------------------------------


@_query("PAT6_singleton", "SELECT CAST(p_partkey AS VARCHAR) AS symbol, 'Singleton' AS pattern FROM part WHERE p_partkey % 4 < 2")
def _(spark, sf_dir):
    """Both marks in two classes of four, one of the two in the others."""
    bodies = F.array(*[F.array(*[F.lit(l) for l in b]) for b in (("class A:", "  _instance = None", "  def get_instance(c): pass"), ("_instance;", "getInstance() {}"), ("  _instance = None", "  def instances(c): pass"), ("def instance(): pass",))])
    x = R._table(spark, sf_dir, "part").select(F.lit("j").alias("job_id"), F.lit("p").alias("path"), F.lit(1).cast("long").alias("file_seq"), F.lit(1).alias("sym_seq"), F.col("p_partkey").cast("string").alias("name"), F.lit(1).alias("start_line"), F.array().cast("array<string>").alias("method_names"), F.lit(None).cast("long").alias("subclasses"), F.get(bodies, (F.col("p_partkey") % 4).cast("int")).alias("body"))
    return design.class_patterns(x).select("symbol", "pattern")


@_query("SOL6_by_principle", f"WITH {R._COUNTED}, v AS (SELECT job_id, 'SRP' AS principle FROM c WHERE methods > {V.SRP_METHODS} OR n > {V.SRP_LOC} UNION ALL SELECT job_id, 'ISP' FROM c WHERE regexp_matches(name, '^I[A-Z]') AND methods > {V.ISP_METHODS}) SELECT job_id, principle, count(*) AS n FROM v GROUP BY ALL", "functions", "classes")
def _(spark, sf_dir):
    counted = findings.with_method_counts(R._code(spark, sf_dir))
    return design.count_by(design.srp(counted).unionByName(design.isp(counted)), "principle")


@_query("PAT14_by_pattern", "SELECT job_id, 'Factory' AS pattern, count(*) AS n FROM functions WHERE kind = 'function' AND regexp_matches(lower(name), '^(create_|make_|build_)') AND complexity > 2 GROUP BY job_id", "functions")
def _(spark, sf_dir):
    return design.count_by(design.factory_functions(frame(spark, sf_dir, "functions")), "pattern")


# --- database, diagrams ------------------------------------------------------


@_query("DB0_all_tables", "SELECT job_id, 'M' || file_seq AS name, 'prisma' AS orm, path AS file, 'id:Int:true,owner:M' || (file_seq + 20) || ':false' AS columns FROM sources WHERE file_seq % 5 = 0", "sources")
def _(spark, sf_dir):
    t = database.detect_tables(R._code_once(spark, sf_dir))
    return t.select("job_id", "name", "orm", "file", F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"], c["primary_key"].cast("string"))), ",").alias("columns"))


@_query("DIA8_tables", "SELECT job_id, 'M' || file_seq AS source, 'M' || (file_seq + 20) AS target, 'owner' AS label FROM sources WHERE file_seq % 5 = 0 AND (job_id, 'M' || (file_seq + 20)) IN (SELECT (job_id, 'M' || file_seq) FROM sources WHERE file_seq % 5 = 0)", "sources")
def _(spark, sf_dir):
    tables = database.prisma_models(frame(spark, sf_dir, "sources"))
    return diagrams.er_diagram(tables, database.relationships(tables))[1].select("job_id", "source", "target", "label")


_CAPPED = "n AS (SELECT 'job' || CAST(o_custkey % 3 AS VARCHAR) AS job_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) AS r FROM orders)"


@_query("DIA1_capped_edges", f"WITH {_CAPPED}, c AS (SELECT * FROM n WHERE r <= 300) SELECT a.job_id, CAST(a.k AS VARCHAR) AS source, CAST(a.k + 2 AS VARCHAR) AS target, CAST(row_number() OVER (PARTITION BY a.job_id ORDER BY a.k) AS INT) AS position FROM c a JOIN c b ON a.job_id = b.job_id AND b.k = a.k + 2")
def _(spark, sf_dir):
    """An edge from each order to the one two numbers on."""
    x = R._table(spark, sf_dir, "orders").select(F.concat(F.lit("job"), (F.col("o_custkey") % 3).cast("string")).alias("job_id"), F.col("o_orderkey").alias("k"))
    key, then = F.col("k").cast("string"), (F.col("k") + 2).cast("string")
    capped = diagrams.cap(diagrams._node(x, "d", key, "t", "l", diagrams._o(F.col("k"))), diagrams._edge(x, "d", key, then, "", "t", diagrams._o(F.col("k"))))
    return capped[1].select("job_id", "source", "target", "position")


def _graph_nodes(spark, sf_dir) -> DataFrame:
    """Classes, methods and functions of the fixtures, one row an id."""
    first = F.min(F.struct("file_seq", F.col("sym_seq").alias("seq"))).alias("first")
    f = frame(spark, sf_dir, "functions").withColumn("id", T.symbol_id("path", "name", "parent_class"))
    f = f.groupBy("job_id", "id", "path", "name", "parent_class").agg(first).select("job_id", "id", F.when(F.col("parent_class").isNull(), "function").otherwise("method").alias("type"), "name", F.col("path").alias("file"), "parent_class", "first")
    c = frame(spark, sf_dir, "classes").withColumn("id", T.symbol_id("path", "name"))
    c = c.groupBy("job_id", "id", "path", "name").agg(first, F.min("base_classes").alias("base_classes")).select("job_id", "id", F.lit("class").alias("type"), "name", F.col("path").alias("file"), "base_classes", "first")
    return f.unionByName(c, allowMissingColumns=True).withColumn("complexity", F.lit(1))


@_query("DIA5_call_graph", f"WITH e AS ({R.ORACLE_SQL['GRA9_calls_edges']}) SELECT job_id, source AS id, regexp_extract(source, '[^:.]*$') AS label FROM e UNION SELECT job_id, target, regexp_extract(target, '[^:.]*$') FROM e")
def _(spark, sf_dir):
    f = frame(spark, sf_dir, "functions").withColumn("id", T.symbol_id("path", "name", "parent_class"))
    return diagrams.call_graph(_graph_nodes(spark, sf_dir).where("type <> 'class'"), graph.calls_edges(f))[0].select("job_id", "id", "label")


@_query("DIA6_classes", """WITH c AS (SELECT DISTINCT job_id, path, name FROM classes), f AS (SELECT DISTINCT job_id, path, parent_class AS name, name AS method FROM functions WHERE parent_class IS NOT NULL)
SELECT job_id, path || '::' || name AS id, coalesce(array_to_string(list(method ORDER BY method) FILTER (method IS NOT NULL), ','), '') AS methods FROM c LEFT JOIN f USING (job_id, path, name) GROUP BY job_id, path, name""", "functions", "classes")
def _(spark, sf_dir):
    nodes = _graph_nodes(spark, sf_dir)
    m = nodes.where("type = 'method'").select("job_id", F.concat("file", F.lit("::"), "parent_class").alias("source"), F.col("id").alias("target"), F.lit("defines").alias("type"), F.lit(0).alias("file_seq"), F.lit(0).alias("seq"))
    n = diagrams.class_diagram(nodes, m)[0]
    return n.select("job_id", "id", F.array_join(F.from_json(F.col("data")["methods"], "array<string>"), ",").alias("methods"))


@_query("DIA3_modules", f"WITH {R._RESOLVED} SELECT DISTINCT job_id, path AS source, coalesce(target, 'external::' || {R._ROOT}) AS target FROM r", "imports", "web_files")
def _(spark, sf_dir):
    files = frame(spark, sf_dir, "web_files")
    e = graph.import_edges(frame(spark, sf_dir, "imports"), files)
    n = files.select("job_id", F.col("path").alias("id"), F.lit("file").alias("type"), F.lit(None).cast("string").alias("name"), "language", F.struct("file_seq", F.lit(0).alias("seq")).alias("first"))
    return diagrams.module_dependency(n, e)[1].select("job_id", "source", "target")


_DEPENDS = ("    depends_on:\n      db:\n        condition: service_healthy\n      cache:\n        condition: service_started", "    depends_on: [db, 'cache']", "    depends_on:\n    - db\n    - \"cache\"", "    command: depends_on")


@_query("DIA11_services", "SELECT CAST(p_partkey AS VARCHAR) AS job_id, 'web' AS source, unnest(['db', 'cache']) AS target FROM part WHERE p_partkey % 4 < 3")
def _(spark, sf_dir):
    """Dependencies as a map with conditions, in a line, or as items; comments at any indent."""
    text = F.concat(F.lit("services:\n  web:\n# a comment\n    image: w:1 # latest\n"), F.get(F.array(*[F.lit(d) for d in _DEPENDS]), (F.col("p_partkey") % 4).cast("int")), F.lit("\n    ports:\n      - 80\n  db:\n    image: pg\n  cache:\n    image: redis\nvolumes:\n  other:\n"))
    s = R._table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("job_id"), F.lit(1).alias("file_seq"), F.lit("docker-compose.yml").alias("path"), text.alias("source"))
    none = spark.createDataFrame([], "job_id string, orm string")
    return diagrams.deployment(s.select("job_id"), s, none, none)[1].select("job_id", "source", "target")


@_query("DIA12_DIA14_sequence", f"WITH {R._ENDS}, n AS (SELECT job_id, file, row_number() OVER (PARTITION BY job_id ORDER BY CAST(regexp_extract(file, 'x(\\d+)', 1) AS BIGINT), line) - 1 AS i FROM e) SELECT job_id, 'seq' || i || '::client->seq' || i || '::' || file || '::f:1' AS id, '1' AS label FROM n WHERE i < 3", "sources")
def _(spark, sf_dir):
    """The first three endpoints of each job; their handlers call nothing."""
    code = R._code_once(spark, sf_dir)
    return diagrams.sequence(api_surface.endpoints(code.sources), code.functions, graph.nodes(code), graph.edges(code))[1].select("job_id", "id", "label")


@_query("RAG1_RAG4_RAG5_index", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY file_seq) - 1 AS i FROM sources)
SELECT job_id || '::' || i AS chunk_id, path AS file, CASE WHEN file_seq % 5 = 0 THEN 1 ELSE 3 END AS start_line, CASE WHEN file_seq % 5 = 0 THEN 5 ELSE 3 END AS end_line, 256 AS dims FROM c WHERE i < 4000""", "sources")
def _(spark, sf_dir):
    """By symbol where a file has one, else by window."""
    x = retrieval.index(retrieval.chunk_repository(R._code_once(spark, sf_dir)))
    return x.select("chunk_id", "file", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.size("embedding").alias("dims"))


# --- parsing -----------------------------------------------------------------

#: Language, suffix, source; then its symbols as kind, name, owner, first and last line.
CODE = [
    ("python", ".py", "import os\nclass A(B):\n    def m(self):\n        return go(1)\n\ndef f(x):\n    if x:\n        pass\n", [("class", "A", "", 2, 4), ("method", "m", "A", 3, 4), ("function", "f", "", 6, 8)]),
    ("javascript", ".js", "import x from 'y';\nclass A extends B {\n  m(a) {\n    return go(1);\n  }\n}\nfunction f(x) {\n  return x;\n}\n", [("class", "A", "", 2, 6), ("method", "m", "A", 3, 5), ("function", "f", "", 7, 9)]),
    ("typescript", ".ts", "export class A extends B {\n  m(a: number): void {\n    go(a);\n  }\n}\nexport function f(x: string) {\n  return x;\n}\n", [("class", "A", "", 1, 5), ("method", "m", "A", 2, 4), ("function", "f", "", 6, 8)]),
    ("java", ".java", "import a.b.C;\npublic class A extends B {\n  public int m(int a) {\n    return go(a);\n  }\n}\n", [("class", "A", "", 2, 6), ("method", "m", "A", 3, 5)]),
    ("go", ".go", "package p\nimport \"fmt\"\nfunc f(x int) int {\n  return go1(x)\n}\n", [("function", "f", "", 3, 5)]),
    ("rust", ".rs", "use a::b;\nfn f(x: i32) -> i32 {\n  go(x)\n}\n", [("function", "f", "", 2, 4)]),
    ("php", ".php", "<?php\nclass A extends B {\n  public function m($a) {\n    return go($a);\n  }\n}\nfunction f($x) {\n  return $x;\n}\n", [("class", "A", "", 2, 6), ("method", "m", "A", 3, 5), ("function", "f", "", 7, 9)]),
    ("csharp", ".cs", "using System;\nclass A : B {\n  public int M(int a) {\n    return Go(a);\n  }\n}\n", [("class", "A", "", 2, 6), ("method", "M", "A", 3, 5)]),
    ("cpp", ".cpp", "#include <x>\nint f(int x) {\n  return go(x);\n}\n", [("function", "f", "", 2, 4)]),
    ("c", ".c", "#include <x.h>\nint f(int x) {\n  return go(x);\n}\n", [("function", "f", "", 2, 4)]),
    ("tsx", ".tsx", "export function F(p: P) {\n  return go(p);\n}\n", [("function", "F", "", 1, 3)]),
]
_SYMBOLS = ", ".join(f"({i}, {', '.join(map(repr, s))})" for i, (_, _, _, ss) in enumerate(CODE) for s in ss)


@_query("PAR3_PAR9_symbols", f"SELECT CAST(p_partkey AS VARCHAR) AS job_id, kind, name, owner, CAST(a AS INT) AS start_line, CAST(z AS INT) AS end_line FROM part JOIN (VALUES {_SYMBOLS}) AS v(k, kind, name, owner, a, z) ON p_partkey % {len(CODE)} = k")
def _(spark, sf_dir):
    """Each part a file in one of eleven languages."""
    at = (F.col("p_partkey") % len(CODE)).cast("int")
    pick = lambda c: F.get(F.array(*[F.lit(x[c]) for x in CODE]), at)
    x = R._table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("job_id"), F.lit(0).cast("long").alias("file_seq"), F.concat(F.lit("a"), pick(1)).alias("path"), pick(2).alias("source"))
    x = x.select("*", T.language("path").alias("language"), F.octet_length("source").cast("long").alias("size_bytes"), F.size(T.lines("source")).alias("loc"))
    return parsing.Code(parsing.parse_files(x)).symbols.select("job_id", "kind", "name", F.coalesce("parent_class", F.lit("")).alias("owner"), "start_line", "end_line")


#: Language, suffix, import and what it names, head of a class and its bases, decorator, head of a function and
#: its name, a branch and a loop as they begin, whether a call stands with its arguments.  ~ stands for the part's
#: key, « and » for braces, which mean tables in SQL here, § for a backslash.
_GRAMMARS = [
    ("javascript", ".js", "import x from 'm~';", "m~", "class A extends B~ «", "B~", "", "  m(a) «", "m", "if (a) «", "while (b) «", False),
    ("typescript", ".ts", "import « x » from 'm~';", "m~", "class A<T extends object = «»> extends B~<T> «", "B~,T", "@D(~)", "  m<K>(a: « x: K »): Map<K, « y: T »> «", "m", "if (a) «", "for (const x of b) «", False),
    ("tsx", ".tsx", "import x from 'm~';", "m~", "", "", "", "export const f = (p: P): string => «", "<anonymous>", "if (p) «", "while (b) «", False),
    ("java", ".java", "import a.m~;", "a.m~", "class A<T extends C> extends B~ «", "B~", "@T(~)", "  public List<T> m(int a) throws E «", "m", "if (a) «", "for (int i : b) «", True),
    ("go", ".go", "import \"m~\"", "m~", "", "", "", "func f(a interface«», c rune) (int, error) «", "f", "if c == '«' «", "for b «", False),
    ("rust", ".rs", "use a::m~;", "a::m~", "", "", "", "fn f<'a>(x: &'a str, y: &'a str) -> &'a str «", "f", "if x == '«' «", "while b «", False),
    ("php", ".php", "<?php use A§m~;", "A\\m~", "class A extends B~ «", "B~", "#[T(~)]", "  public function m(?int $a): ?int «", "m", "if ($a) «", "foreach ($b as $c) «", False),
    ("csharp", ".cs", "using A.m~;", "A.m~", "class A<T> : B~ where T : C «", "B~", "[T(~)]", "  public int m<K>(int a) where K : Z «", "m", "if (a) «", "foreach (var x in b) «", False),
    ("cpp", ".cpp", "#include <m~.h>", "m~.h", "", "", "", "A::A(int x) : x_(1), y_«2» «", "A::A", "if (x == '«') «", "while (b) «", False),
    ("c", ".c", "#include \"m~.h\"", "m~.h", "", "", "", "static struct p *f(int a) «", "f", "if (a) «", "for (;;) «", False),
]
_grammar = lambda c: "CASE CAST(p_partkey % 10 AS INT) " + " ".join(f"WHEN {i} THEN '" + str(g[c]).replace("'", "''") + "'" for i, g in enumerate(_GRAMMARS)) + " END"
_filled = lambda c: f"replace({_grammar(c)}, '~', CAST(p_partkey AS STRING))"
_braced = lambda x: f"replace(replace(replace({x}, '«', chr(123)), '»', chr(125)), '§', chr(92))"
_N, _M = "CAST(p_size % 5 AS INT)", "CAST(p_size % 3 AS INT)"  # nested branches, and nested loops after them
MADE["measured"] = (
    f"SELECT {_PART}, 'r/a' || {_grammar(1)} AS path, "
    + _braced(
        f"{_filled(2)} || chr(10) || {_filled(4)} || chr(10) || {_filled(6)} || chr(10) || {_filled(7)} || chr(10) || repeat({_grammar(9)} || chr(10), {_N}) || 'go' || CAST(p_partkey AS STRING) || '(1);' || chr(10) || repeat('»' || chr(10), {_N}) "
        f"|| repeat({_grammar(10)} || chr(10), {_M}) || repeat('»' || chr(10), {_M}) || '»' || chr(10) || CASE WHEN {_grammar(4)} = '' THEN '' ELSE '»' END"
    )
    + " AS source FROM {part}"
)


@_query("PAR4_PAR13_measured", f"""WITH x AS (SELECT *, {_N} AS d, {_M} AS l, CAST(p_partkey % 10 AS INT) AS k, {_filled(3)} AS imports, {_filled(5)} AS bases, {_filled(6)} AS decorator, {_grammar(8)} AS name, 'go' || p_partkey || CASE WHEN {_grammar(11)} = 'True' THEN '(1)' ELSE '' END AS call FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS job_id, imports, 'class' AS kind, 'A' AS name, '' AS owner, '' AS decorators, bases, '' AS calls, 1 AS complexity, 0 AS depth, 0 AS loops FROM x WHERE bases <> ''
UNION ALL SELECT CAST(p_partkey AS VARCHAR), imports, CASE WHEN bases = '' THEN 'function' ELSE 'method' END, name, CASE WHEN bases = '' THEN '' ELSE 'A' END, decorator, '', call, 1 + d + l, greatest(d, l), l FROM x""")
def _(spark, sf_dir):
    """Each part a file in one of ten languages, whose function nests as deep as its size says."""
    x = made(spark, sf_dir, "measured").withColumn("file_seq", F.lit(0).cast("long"))
    x = x.select("*", T.language("path").alias("language"), F.octet_length("source").cast("long").alias("size_bytes"), F.size(T.lines("source")).alias("loc"))
    joined = lambda c: F.array_join(c, ",")
    parsed = parsing.parse_files(x).select("job_id", joined("imports").alias("imports"), F.explode("symbols").alias("s"))
    return parsed.select("job_id", "imports", "s.kind", "s.name", F.coalesce("s.parent_class", F.lit("")).alias("owner"), joined("s.decorators").alias("decorators"), joined("s.base_classes").alias("bases"), joined("s.calls").alias("calls"), "s.complexity", F.col("s.max_nesting_depth").alias("depth"), F.col("s.max_loop_nesting").alias("loops"))
