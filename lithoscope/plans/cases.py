"""Queries whose rows are made from columns of the tables, one case for every rule: the
routes, authentication rules, markers and candidates of the operators, the walk of calls,
key lookups of jobs, nearest vectors.  The SQL says what the columns should lead to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound, NotReady
from ..functions import text as T
from ..functions import values as V
from ..operators import api_surface, design, diagrams, findings, graph, semantic, vector_index
from ..sources import archive
from ..sources.store import JOBS, Store, shared_folder
from . import checks as K
from . import registry as R


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R._table(spark, sf_dir, "part")


def _pick(values: list[str], at: Column) -> Column:
    """The value of that number, with ~ for the part's key."""
    return F.replace(F.get(F.array(*[F.lit(v) for v in values]), at.cast("int")), F.lit("~"), _key())


def _rows(values: list[tuple]) -> str:
    """A VALUES list of rows, each with its number first."""
    return ", ".join(f"({i}, {R._quote(v)})" for i, v in enumerate(values))


# --- endpoints ---------------------------------------------------------------

#: Code, framework, method and path that it is an endpoint of.
_ROUTES = [
    ('@router.patch(\n  "/a~")', "fastapi/flask", "PATCH", "/a~"),
    ('@app.websocket("/b~")', "fastapi", "WEBSOCKET", "/b~"),
    ("@bp.route( '/c~', methods=['GET'])", "flask", "ANY", "/c~"),
    ('router.delete("/d~", f)', "express", "DELETE", "/d~"),
    ("@Post('e~')", "nestjs", "POST", "e~"),
    ('@PutMapping(value = "/f~")', "spring", "PUT", "/f~"),
    ('@RequestMapping("/g~")', "spring", "ANY", "/g~"),
    ("Route::get('/h~', 'C@m')", "laravel", "GET", "/h~"),
    ("[HttpDelete]", "aspnet", "DELETE", "(dynamic)"),
]


@R._query("API1_every_route", f"""WITH v(k, code, framework, method, path) AS (VALUES {_rows(_ROUTES)}),
p AS (SELECT p_partkey AS key, p_partkey % 9 AS a, (p_partkey + 1 + p_size % 8) % 9 AS b, p_size % 7 AS above, p_partkey % 4 AS between FROM part),
e AS (SELECT key, a AS k, 1 + above AS line FROM p UNION ALL SELECT key, b, 2 + above + between + CASE a WHEN 0 THEN 1 ELSE 0 END FROM p)
SELECT CAST(key AS VARCHAR) AS file, framework, method, replace(path, '~', CAST(key AS VARCHAR)) AS path, CAST(line AS INT) AS line FROM e JOIN v USING (k)""")
def _(spark, sf_dir):
    """Two of nine routes a file, with as many lines above and between them as columns say."""
    code = [r[0] for r in _ROUTES]
    first, then = F.col("p_partkey") % 9, (F.col("p_partkey") + 1 + F.col("p_size") % 8) % 9
    lines = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    source = F.concat(lines("x = 1\n", F.col("p_size") % 7), _pick(code, first), F.lit("\n"), lines("\n", F.col("p_partkey") % 4), _pick(code, then))
    s = _part(spark, sf_dir).select(F.lit("j").alias("job_id"), F.col("p_partkey").alias("file_seq"), _key().alias("path"), source.alias("source"))
    return api_surface.endpoints(s).select("file", "framework", "method", "path", "line")


#: An import or code, and the mechanism that it tells.
_AUTH = [
    ("import", "PyJWT", "JWT"), ("import", "passport-jwt", "Passport.js"), ("import", "next-oauth~", "OAuth"), ("import", "django.contrib.auth", "Django auth"), ("import", "flask_login", "Flask-Login"),
    ("import", "org.springframework.security.web", "Spring Security"), ("code", "x = HTTPBearer()", "OAuth2/Bearer token"), ("code", "@UseGuards(G~)", "NestJS guards"), ("code", "[Authorize]", "ASP.NET [Authorize]"),
    ("code", "@jwt_required", "Flask decorator-based auth"), ("code", "nothing ~", ""),
]


@R._query("API3_every_rule", f"""WITH v(k, kind, text, m) AS (VALUES {_rows(_AUTH)}), p AS (SELECT p_partkey AS key, p_partkey % 11 AS a, (p_partkey + p_size) % 11 AS b FROM part),
m AS (SELECT DISTINCT key, m FROM p JOIN v ON v.k = p.a OR v.k = p.b WHERE m <> '')
SELECT CAST(p.key AS VARCHAR) AS job_id, coalesce(string_agg(m, ',' ORDER BY m), '') AS mechanisms, count(m) > 0 AS auth_detected FROM p LEFT JOIN m USING (key) GROUP BY p.key""")
def _(spark, sf_dir):
    """Each part a repository with two of the marks of eleven kinds, which may be one kind twice."""
    p = _part(spark, sf_dir)
    two = F.explode(F.array_distinct(F.array(F.col("p_partkey") % 11, (F.col("p_partkey") + F.col("p_size")) % 11)))
    x = p.select("p_partkey", "p_size", two.alias("k")).select(_key().alias("job_id"), _pick([a[0] for a in _AUTH], F.col("k")).alias("kind"), _pick([a[1] for a in _AUTH], F.col("k")).alias("text"))
    sources = x.select("job_id", F.lit("a.py").alias("path"), F.lit(0).cast("long").alias("file_seq"), F.when(F.col("kind") == "code", F.col("text")).otherwise("").alias("source"))
    none = spark.createDataFrame([], "job_id string, kind string, name string, decorators array<string>")
    found = api_surface.detect_api_surface(sources, none, x.where("kind = 'import'").select("job_id", F.col("text").alias("raw")))
    return found.select("job_id", F.array_join("mechanisms", ",").alias("mechanisms"), "auth_detected")


# --- patterns, principles ----------------------------------------------------

_MARKS = ["def f(x = Depends(y~)): pass", "@Autowired S~ s;", "@Inject(T~)", "@Injectable()", "@inject U~", "depends(~) injectable", "Inject ~", ""]


@R._query("PAT12_every_marker", "SELECT CAST(p_partkey AS VARCHAR) AS file FROM part WHERE p_partkey % 8 < 5 OR (p_partkey + p_size) % 8 < 5")
def _(spark, sf_dir):
    """Two of eight pieces of code a file, of which five are markers."""
    source = F.concat_ws("\n", _pick(_MARKS, F.col("p_partkey") % 8), _pick(_MARKS, (F.col("p_partkey") + F.col("p_size")) % 8))
    s = _part(spark, sf_dir).select(F.lit("j").alias("job_id"), F.col("p_partkey").alias("file_seq"), _key().alias("path"), source.alias("source"))
    return design.injections(s).select("file")


_PATTERN_SQL = f"""SELECT job_id, pattern, file FROM ({R.ORACLE_SQL['PAT1_PAT10_class_patterns']}) UNION ALL SELECT job_id, 'Factory', file FROM ({R.ORACLE_SQL['PAT11_factory_functions']})
UNION ALL SELECT job_id, 'CQRS', file FROM ({R.ORACLE_SQL['PAT13_cqrs']}) UNION ALL SELECT job_id, 'Dependency Injection', file FROM ({R.ORACLE_SQL['PAT12_injection']})"""


@R._query("PAT14_every_pattern", f"SELECT job_id, pattern, count(*) AS n FROM ({_PATTERN_SQL}) GROUP BY ALL")
def _(spark, sf_dir):
    """How often each pattern was found, of all detectors."""
    c = R._code(spark, sf_dir)
    counted = findings.with_method_counts(c).join(design.subclass_counts(c.classes), ["job_id", "name"], "left").withColumn("body", F.array(F.lit("")))
    marked = R.frame(spark, sf_dir, "sources").withColumn("source", F.replace("source", F.lit("@login_required"), F.lit("@Injectable()")))
    found = [design.class_patterns(counted), design.factory_functions(c.functions), design.cqrs(c.classes), design.injections(marked)]
    all_ = found[0].select("job_id", "pattern")
    for x in found[1:]:
        all_ = all_.unionByName(x.select("job_id", "pattern"))
    return design.count_by(all_, "pattern")


_SMELLS = f"SELECT job_id, 'quality' AS tab FROM ({R.ORACLE_SQL['QUA2_QUA3_QUA4_functions']}) UNION ALL SELECT job_id, 'performance' FROM ({R.ORACLE_SQL['PER4_expensive_loops']})"


@R._query("FE3_tab_counts", f"""SELECT job_id, tab, count(*) AS n FROM ({_SMELLS} UNION ALL SELECT job_id, 'solid' FROM ({R.ORACLE_SQL['SOL1_SOL4_classes']})
UNION ALL SELECT job_id, 'patterns' FROM ({R.ORACLE_SQL['PAT11_factory_functions']}) UNION ALL SELECT job_id, 'security' FROM ({R.ORACLE_SQL['SEC5_weak_auth']})) GROUP BY ALL""")
def _(spark, sf_dir):
    """How many rows each list of results has, for some detectors of each."""
    c, lines = R._code(spark, sf_dir), R.frame(spark, sf_dir, "code_lines")
    f, counted = c.functions, findings.with_method_counts(c)
    found = findings._union([findings.complex_functions(f), findings.long_methods(f), findings.deep_nesting(f), findings.expensive_loops(f), findings.weak_auth(lines)])
    return findings.tab_counts(design.factory_functions(f), design.srp(counted).unionByName(design.isp(counted)), found)


@R._query("FE5_shown_methods", f"""SELECT job_id, id, array_to_string(string_split(methods, ',')[1:10], ',') AS shown, CASE WHEN methods = '' THEN 0 ELSE greatest(0, len(string_split(methods, ',')) - 10) END AS more FROM ({R.ORACLE_SQL['DIA6_classes']})""")
def _(spark, sf_dir):
    """Ten methods of each class node, and how many more there are."""
    nodes = K._graph_nodes(spark, sf_dir)
    owner = F.concat("file", F.lit("::"), "parent_class")
    m = nodes.where("type = 'method'").select("job_id", owner.alias("source"), F.col("id").alias("target"), F.lit("defines").alias("type"), F.lit(0).alias("file_seq"), F.lit(0).alias("seq"))
    x = diagrams.shown_methods(diagrams.class_diagram(nodes, m)[0])
    return x.select("job_id", "id", F.array_join("shown", ",").alias("shown"), F.col("more").cast("long").alias("more"))


# --- imports -----------------------------------------------------------------

_TAILS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]


@R._query("GRA6_every_candidate", f"""WITH v(k, tail) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(_TAILS))}), p AS (SELECT p_partkey AS key, p_partkey % 9 AS a, (p_partkey + p_size) % 9 AS b FROM part)
SELECT CAST(key AS VARCHAR) AS job_id, CASE WHEN min(k) IS NULL THEN 'external::lib' ELSE 'src/lib/m' || min_by(tail, k) END AS target FROM p LEFT JOIN v ON v.k = p.a OR v.k = p.b GROUP BY key""")
def _(spark, sf_dir):
    """Each part a repository with an import and up to two of the files that it may mean: the first in order counts."""
    p = _part(spark, sf_dir)
    tail = F.get(F.array(*[F.lit(t) for t in _TAILS]), F.col("k").cast("int"))
    two = F.explode(F.array_distinct(F.array(F.col("p_partkey") % 9, (F.col("p_partkey") + F.col("p_size")) % 9)))
    hits = p.select("p_partkey", two.alias("k")).where("k < 8").select(_key().alias("job_id"), F.col("k").alias("file_seq"), F.concat(F.lit("src/lib/m"), tail).alias("path"))
    # a second file of each stem, so that no stem is the only one
    files = hits.unionByName(hits.select("job_id", "file_seq", F.concat(F.lit("other/"), T.basename("path")).alias("path"))).unionByName(p.select(_key().alias("job_id"), F.lit(99).cast("long").alias("file_seq"), F.explode(F.array(*[F.lit(f"far{i}/{n}") for i in (1, 2) for n in ("m", "m.ts", "index.ts", "index.js", "index.tsx")])).alias("path")))
    imports = p.select(_key().alias("job_id"), F.lit(0).cast("long").alias("file_seq"), F.lit("src/app/a.ts").alias("path"), F.lit(0).alias("imp_seq"), F.lit("../lib/./m").alias("raw"))
    return graph.import_edges(imports, files).select("job_id", "target")


# --- the walk of calls -------------------------------------------------------

_TREE = "t AS (SELECT p_partkey // 60 AS g, p_partkey % 60 AS i FROM part), j AS (SELECT g FROM t WHERE i < 3 GROUP BY g HAVING count(*) = 3)"


@R._query("DIA12_DIA14_walk", f"""WITH RECURSIVE {_TREE},
e AS (SELECT a.g, a.i AS u, b.i AS v, CASE WHEN b.i > a.i THEN b.i - 2 * a.i ELSE 3 END AS o FROM t a JOIN t b ON a.g = b.g AND (b.i = 2 * a.i + 1 OR b.i = 2 * a.i + 2 OR b.i = (a.i - 1) // 2 AND a.i > 0)),
w AS (SELECT g, flow, flow AS node, CAST(NULL AS BIGINT) AS source, 1 AS level, [flow] AS seen, '' AS k FROM j, (VALUES (0), (1), (2)) AS f(flow)
UNION ALL SELECT w.g, w.flow, e.v, w.node, w.level + 1, list_append(w.seen, e.v), w.k || e.o FROM w JOIN e ON e.g = w.g AND e.u = w.node WHERE w.level <= {V.FLOW_DEPTH} AND NOT list_contains(w.seen, e.v))
SELECT CAST(g AS VARCHAR) AS job_id, 'seq' || flow || '::f.py::f' || source AS source, 'seq' || flow || '::f.py::f' || node AS target, CAST(level AS VARCHAR) AS label, CAST(row_number() OVER (PARTITION BY g, flow ORDER BY k) AS INT) AS place FROM w WHERE level > 1""")
def _(spark, sf_dir):
    """Sixty parts a repository: each function calls two more and its own caller, so that
    walks branch, run into cycles and end at the fourth level."""
    p = _part(spark, sf_dir).select(F.floor(F.col("p_partkey") / 60).cast("string").alias("job_id"), (F.col("p_partkey") % 60).alias("i"))
    whole = p.where("i < 3").groupBy("job_id").agg(F.count("*").alias("n")).where("n = 3").select("job_id")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    node = lambda c: F.concat(F.lit("f.py::"), name(c))
    functions = p.select("job_id", F.lit("f.py").alias("path"), F.col("i").alias("sym_seq"), name(F.col("i")).alias("name"), F.lit(None).cast("string").alias("parent_class"), (F.col("i") * 10 + 1).cast("int").alias("start_line"), (F.col("i") * 10 + 5).cast("int").alias("end_line"))
    ends = p.where("i < 3").join(whole, "job_id").select("job_id", F.lit("f.py").alias("file"), F.lit("GET").alias("method"), F.concat(F.lit("/"), F.col("i").cast("string")).alias("path"), (F.col("i") * 10 + 1).cast("int").alias("line"), F.lit(0).alias("file_seq"), F.col("i").alias("seq"))
    called = F.explode(F.array(F.struct(F.lit(1).alias("o"), (F.col("i") * 2 + 1).alias("v")), F.struct(F.lit(2).alias("o"), (F.col("i") * 2 + 2).alias("v")), F.struct(F.lit(3).alias("o"), F.floor((F.col("i") - 1) / 2).alias("v"))))
    e = p.select("job_id", "i", called.alias("c")).select("job_id", "i", "c.o", "c.v").join(p.select("job_id", F.col("i").alias("v")), ["job_id", "v"])
    edges = e.select("job_id", node(F.col("i")).alias("source"), node(F.col("v")).alias("target"), F.lit("calls").alias("type"), F.lit(0).alias("file_seq"), F.col("o").alias("seq"))
    nodes = p.select("job_id", node(F.col("i")).alias("id"), name(F.col("i")).alias("name"))
    steps = diagrams.sequence(ends, functions, nodes, edges)[1].where("NOT endswith(source, '::client')")
    flow = F.substring_index("source", "::", 1)
    # order within a flow, as the diagram's rows have it
    order = F.row_number().over(diagrams.W.partitionBy("job_id", flow).orderBy("o"))
    return steps.select("job_id", "source", "target", "label", order.alias("place"))


# --- jobs --------------------------------------------------------------------


@R._query("SRC18_key_lookups", """WITH k AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders), s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'running' END AS status FROM orders),
q AS (SELECT a AS k FROM k UNION SELECT a + 1 FROM k UNION SELECT b FROM k UNION SELECT b + 1 FROM k)
SELECT CAST(q.k AS VARCHAR) AS job_id, coalesce(status, 'NotFound') AS found, CASE WHEN status IS NULL THEN 'NotFound' WHEN status = 'done' THEN 'done' ELSE 'NotReady' END AS finished FROM q LEFT JOIN s ON s.k = q.k""")
def _(spark, sf_dir):
    """Orders as jobs that are done or not: what the lookups by key say of four keys."""
    o = R._table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    x = o.select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit("n").alias("name"), F.lit("local").alias("source_type"), F.lit("r").alias("source_ref"), F.explode(F.when(even, F.array(F.lit("running"), F.lit("done"))).otherwise(F.array(F.lit("running")))).alias("status"), F.lit("done").alias("stage"), F.lit(100).alias("progress"), F.lit("").alias("message"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    store = Store(spark, f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}")
    x.withColumn("seq", (F.col("status") == "done").cast("long")).select(*[c.split()[0] for c in JOBS.split(", ")]).write.parquet(store.path("jobs"))

    def said(lookup, key: str) -> str:
        try:
            return lookup(key).status
        except (NotFound, NotReady) as e:
            return type(e).__name__

    ends = o.agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).first()
    keys = sorted({str(k) for k in (ends["a"], ends["a"] + 1, ends["b"], ends["b"] + 1)})
    return spark.createDataFrame([(k, said(store.job, k), said(store.done_job, k)) for k in keys], "job_id string, found string, finished string")


# --- archives ----------------------------------------------------------------


@R._query("SRC2_SRC7_archives", f"""WITH f AS (SELECT file_seq // 50 AS j, path, max(source) AS source FROM code_files GROUP BY ALL),
k AS (SELECT * FROM f WHERE len(list_intersect(string_split(path, '/')[:-2], [{R._quote(V.IGNORED_DIRS)}])) = 0 AND NOT regexp_extract(path, '[^/]*$') IN ({R._quote(V.IGNORED_NAMES)})
AND NOT ({' OR '.join(f"ends_with(lower(regexp_extract(path, '[^/]*$')), '{s}')" for s in V.IGNORED_SUFFIXES)}) AND strlen(source) BETWEEN 1 AND 5000)
SELECT CAST(j AS VARCHAR) AS job_id, path, CAST(strlen(source) AS BIGINT) AS size_bytes, md5(source) AS digest FROM k QUALIFY row_number() OVER (PARTITION BY j ORDER BY path) <= 20""", "code_files")
def _(spark, sf_dir):
    """Fifty documents an archive, in every other one below one folder; the first twenty files kept of each."""
    x = R.frame(spark, sf_dir, "code_files").withColumn("j", F.floor(F.col("file_seq") / 50))
    x = x.withColumn("path", F.when(F.col("j") % 2 == 0, F.concat(F.lit("top/"), F.col("path"))).otherwise(F.col("path")))
    rows = archive.unpack(archive.zipped(x, "j"), max_files=20, max_bytes=5000)
    return rows.select("job_id", "path", "size_bytes", F.md5("content").alias("digest"))


# --- vectors -----------------------------------------------------------------


@R._query("RAG6_nearest_of_many", """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query, vec_id AS id, list_sum(list_transform(list_zip(embedding, e), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)) AS s FROM embeddings, q)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY s, id) AS INT) AS rank, id FROM d QUALIFY rank <= 6""")
def _(spark, sf_dir):
    """For every twentieth vector the six nearest, exactly."""
    v = R._table(spark, sf_dir, "embeddings")
    return vector_index.exact(v, v.where("vec_id % 20 = 0"), V.TOP_K).select("query", "rank", "id")


@R._query("RAG6_nearest_by_index")
def _(spark, sf_dir):
    """The same by the inverted file, whose recall tests measure."""
    v = R._table(spark, sf_dir, "embeddings")
    book = vector_index.fit(v)
    if book is None:
        return spark.createDataFrame([], "query long, rank int, id long")
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.index(v, book).write.parquet(path)
    found = vector_index.search(spark.read.parquet(path), v, v.where("vec_id % 20 = 0"), book, V.TOP_K, probes=max(8, len(book.centres) // 2), keep=30)
    return found.select("query", "rank", "id")


_COUNTED = """c AS (SELECT doc_id AS id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce(text, ''), '(\\p{Ll}|\\p{N})(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g')), '[\\p{L}\\p{N}]+')) AS w FROM documents) GROUP BY ALL)"""


@R._query("RAG5_word_weights", f"""WITH {_COUNTED}, n AS (SELECT count(DISTINCT id) AS n FROM c), k AS (SELECT word, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM c, n GROUP BY word, n HAVING count(*) > 1 AND count(*) <= greatest(2.0, 0.5 * n)),
w AS (SELECT id, word, (ln(tf) + 1) * idf AS w FROM c JOIN k USING (word)), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY id)
SELECT id AS doc_id, count(*) AS words, round(max(w / l), 6) AS heaviest, round(sum(w / l), 4) AS total FROM w JOIN l USING (id) GROUP BY id""")
def _(spark, sf_dir):
    """The rows that semantic vectors are made of, each document a chunk."""
    counted = semantic.stash(semantic.counts(R._table(spark, sf_dir, "documents"), "doc_id"), "words")
    a = semantic.weights(counted, semantic.vocabulary(counted))
    return a.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("words"), F.round(F.max("a"), 6).alias("heaviest"), F.round(F.sum("a"), 4).alias("total"))


@R._query("RAG5_nearest_by_meaning")
def _(spark, sf_dir):
    """Benchmark items as questions: the six documents nearest to each by meaning."""
    docs = R._table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    items = R._table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    model, vectors = semantic.fit_embed(docs)
    vectors, asked = (semantic.stash(x, "embedded") for x in (vectors, semantic.embed(items, model)))
    return vector_index.exact(vectors, asked, V.TOP_K, "chunk_id").select("query", "rank", "id")
