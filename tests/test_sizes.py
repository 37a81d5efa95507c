"""Rows that plans make while they run: no more than the input and the answer need."""

import random

from jobs import clone_report
from lithoscope.functions import text as T
from lithoscope.operators import database, design, diagrams, findings, graph, parsing
from lithoscope.plans import registry
from pyspark.sql import functions as F


def _nodes(df):
    """name, rows of every node of a plan that has run."""
    out = []

    def walk(p):
        name, rows = p.nodeName(), p.metrics().get("numOutputRows")
        out.append((name, rows.get().value() if rows.isDefined() else 0))
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if name.endswith("QueryStage"):
            return walk(p.plan())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def most_rows(df):
    return max(n for _, n in _nodes(df))


def test_handlers_meet_by_line_and_span(spark):
    n = 1000
    ids = spark.range(n)
    e = ids.select(F.lit("j").alias("job_id"), F.lit("a.py").alias("file"), F.lit(None).cast("string").alias("method"), F.lit("/").alias("path"), F.when(F.col("id") % 2 == 0, 12).otherwise(40).alias("line"), F.col("id").alias("flow"))
    f = ids.select(F.lit("j").alias("job_id"), F.lit("a.py").alias("path"), F.col("id").alias("sym_seq"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("parent_class"), F.when(F.col("id") < n // 2, 10).otherwise(11).alias("start_line"), F.lit(50).alias("end_line"))
    h = diagrams.handlers(e, f)
    got = h.collect()
    assert len(got) == n and {r["name"] for r in got} == {f"f{n // 2}"}
    assert most_rows(h) <= 4 * n


def test_candidates_of_imports_are_few_and_not_broadcast(spark, tmp_path):
    n = 2000
    spark.range(n).write.parquet(str(tmp_path / "k"))
    k = spark.read.parquet(str(tmp_path / "k"))
    job = F.col("id").cast("string").alias("job_id")
    imports = k.select(job, F.lit(0).cast("long").alias("file_seq"), F.lit("src/a.ts").alias("path"), F.lit(0).alias("imp_seq"), F.lit("./m").alias("raw"))
    files = k.select(job, F.explode(F.array(*[F.lit(f"src/m{t}") for t in (".js", ".ts", ".x", ".y")])).alias("path"))
    e = graph.import_edges(imports, files)
    assert {r["target"] for r in e.collect()} == {"src/m.ts"}
    assert "BroadcastExchange" not in [name for name, _ in _nodes(e)]
    assert most_rows(e) <= 8 * n


def test_methods_are_counted_with_owners_not_paired(spark):
    n = 300
    ids = spark.range(n)
    classes = ids.select(F.lit("j").alias("job_id"), F.lit("a.py").alias("path"), F.lit("K").alias("name"), F.col("id").alias("sym_seq"))
    methods = ids.select(F.lit("j").alias("job_id"), F.lit("a.py").alias("path"), F.lit(0).alias("file_seq"), (F.col("id") + n).alias("sym_seq"), F.lit("K").alias("parent_class"), F.lit("m").alias("name"), F.lit(1).alias("start_line"), F.array(F.lit("x"), F.lit("a.K")).alias("calls"))
    x = design.dip_counts(classes, methods)
    got = x.collect()
    assert len(got) == n and {(r["call"], r["owners"]) for r in got} == {("a.K", n)}
    assert most_rows(x) <= 2 * n
    assert design.dip(classes, methods).count() == n * n


def test_a_small_split_is_parsed_by_many_tasks(spark):
    x = spark.range(64).coalesce(1).select(F.lit("j").alias("job_id"), F.col("id").alias("file_seq"), F.col("id").cast("string").alias("path"), F.lit("python").alias("language"), F.lit(1).cast("long").alias("size_bytes"), F.lit(1).alias("loc"), F.lit("def f(): pass").alias("source"))
    parsed = parsing.parse_files(x)
    assert parsed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and parsed.count() == 64


def test_sources_are_parsed_once(spark):
    for name in ("GRA1_GRA2_nodes", "SRC16_graph_json", "DB0_all_tables", "DIA12_DIA14_sequence"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "symbols" in plan and "MapInArrow" not in plan, name


def test_texts_of_clones_are_cut_once(spark, tmp_path):
    """Counts and places of blocks read the same shuffle."""
    shared = "\n".join(f"a line that several texts hold, number {i}" for i in range(6))
    rows = spark.range(40).select(F.lit("s").alias("job_id"), F.col("id").alias("file_seq"), F.lit("s/1.md").alias("path"), F.lit("markdown").alias("language"), F.concat(F.lit(f"{shared}\n"), F.col("id").cast("string")).alias("source"))
    rows.write.parquet(str(tmp_path / "files"))
    made = clone_report.passages(spark.read.parquet(str(tmp_path / "files")), 3, 2)
    assert {tuple(r)[1:] for r in made.collect()} == {(1, 6, 40, 1, 0, "s")}
    assert "ReusedExchange" in [name for name, _ in _nodes(made)]


def test_lines_and_white_space_are_those_of_python(spark):
    """At every character that is one, also beside others; \\r\\n ends one line."""
    ends = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = [f"a{x}{y}{z}b{x}" for x in ends for y in (*ends, "") for z in (*ends, "c")] + ["", "\n", "\r\n", "a\r\n\r\nb", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.lines("t").alias("l"))
    assert all(r.l == (r.t.splitlines() or []) for r in df.collect())
    chars = spark.range(0x3100).where("id > 0").select(F.col("id").cast("int").alias("n"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    got = chars.select("n", "c", T.strip(F.concat("c", "c", F.lit("x"), "c", F.lit("y"), "c")).alias("s")).collect()
    assert len(got) == 0x30FF and all(r.s == f"{r.c}{r.c}x{r.c}y{r.c}".strip() for r in got if not 0xD800 <= r.n < 0xE000)


def test_walks_are_not_made_of_pandas_objects(spark):
    """Calls and steps of many flows: Python holds those of a few rows."""
    rows = [(f"f{i}", [(f"f{i}", "a"), ("a", "b"), (f"f{i}", "b"), ("b", f"f{i}")] if i % 3 else None) for i in range(250)]
    df = spark.createDataFrame(rows, "start string, c array<struct<source:string,target:string>>").coalesce(1)
    x = df.select("start", diagrams.walked("start", "c").alias("w"))
    assert "ArrowEvalPython" in x._jdf.queryExecution().executedPlan().toString()
    got = {r.start: [tuple(s) for s in r.w] for r in x.collect()}
    assert got == {s: [(s, "a", 2), ("a", "b", 3)] if c else [] for s, c in rows}


def test_decorated_fields_are_found_without_a_shuffle(spark):
    """Against a plain loop, over bodies of lines dealt at random."""
    rng = random.Random(5)
    lines = ["  @A()", "  @B(x)", "  own: X;", "  // note", "", "  call();", "}", "  id: number;"]
    bodies = [[rng.choice(lines) for _ in range(rng.randrange(30))] for _ in range(300)] + [None]

    def plain(body):
        out, marks = [], []
        for line in body or ():
            if line.startswith("  @"):
                marks.append(line[3])
            elif line.strip() and not line.strip().startswith("//"):
                if ":" in line and marks:
                    name, kind = line.strip(" ;").split(": ")
                    out.append((name, kind, marks))
                marks = []
        return out

    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body array<string>").select(F.lit("j").alias("job_id"), F.lit(0).alias("file_seq"), F.lit("a.ts").alias("path"), F.col("n").alias("sym_seq"), "body")
    x = database.decorated_fields(df, "ts")
    assert {r.sym_seq: [tuple(f) for f in r["_f"]] for r in x.collect()} == {i: plain(b) for i, b in enumerate(bodies)}
    assert not [name for name, _ in _nodes(x) if "Exchange" in name]


def test_calls_are_counted_without_a_shuffle(spark):
    rows = [("a", ["x", "y", "x", None, "x", "y", "y", "y"]), ("b", []), ("c", None), ("d", ["x", "x"]), ("e", [None] * 3), ("f", ["q"] * 7)]
    df = spark.createDataFrame(rows, "name string, calls array<string>").select(F.lit("j").alias("job_id"), F.lit(0).cast("long").alias("file_seq"), F.lit("a.py").alias("path"), F.lit("function").alias("kind"), F.ascii("name").alias("sym_seq"), "name", F.lit(1).alias("start_line"), "calls", F.array(F.lit("b")).alias("body"))
    x = findings.missing_cache(df)
    got = sorted((r.symbol, r.message.split(" with")[0], r.seq % 1000) for r in x.collect())
    assert got == [("a", "'x' is called 3 times in 'a'", 0), ("a", "'y' is called 4 times in 'a'", 1), ("e", "'null' is called 3 times in 'e'", 0), ("f", "'q' is called 7 times in 'f'", 0)]
    assert not [name for name, _ in _nodes(x) if "Exchange" in name]


SYMBOLS = "array<struct<sym_seq:int,kind:string,name:string,parent_class:string,base_classes:array<string>,start_line:int,end_line:int>>"


def test_stub_overrides_are_found_without_a_shuffle(spark):
    """Against the plain loop, over files of symbols and lines dealt at random."""
    rng = random.Random(7)
    lines = ["    pass", "    raise  NotImplementedError()", "    return 1", "", " \u2003", "  throw new XError()"]
    bases = [None, [], ["A"], ["x.B", "A"], ["A", "x.y.A", "C"], ["Z"], [None, "B"], ["D"]]

    def symbol(n):
        kind = rng.choice(["class", "method", "method"])
        start = rng.randrange(1, 13)
        return (n, kind, rng.choice("ABCD") if kind == "class" else rng.choice("mno"), rng.choice([None, "", "A", "B", "C", "D", "Z"]), rng.choice(bases) if kind == "class" else [], start, start + rng.randrange(-1, 4))

    files = [("\n".join(rng.choices(lines, (4, 4, 1, 2, 1, 2), k=rng.randrange(15))), [symbol(n) for n in range(rng.randrange(14))]) for _ in range(600)]
    files += [(None, files[0][1]), (files[0][0], None), ("", [])]

    def plain(source, symbols):
        classes = {}
        for s in symbols or ():
            if s[1] == "class":
                classes.setdefault(s[2], (s[4] or [], {}))
        for s in symbols or ():
            if s[1] != "class" and s[3] in classes:
                classes[s[3]][1][s[2]] = s
        for c, (above, methods) in classes.items():
            for m, s in methods.items():
                if any(m in classes.get((b or "").split(".")[-1], ((), ()))[1] for b in above):
                    rest = [x for x in (source or "").splitlines()[s[5] : s[6]] if x.strip()]
                    if rest and all("return" not in x for x in rest):
                        yield f"{c}.{m}", s[5], s[0]

    rows = [(i, source, s and rng.sample(s, len(s))) for i, (source, s) in enumerate(files)]
    df = spark.createDataFrame(rows, f"file_seq long, source string, symbols {SYMBOLS}").select(F.lit("j").alias("job_id"), F.col("file_seq").cast("string").alias("path"), "*")
    x = design.lsp(df)
    got = sorted((r.file_seq, r.symbol, r.line, r.seq) for r in x.collect())
    assert got == sorted((i, *v) for i, (source, s) in enumerate(files) for v in plain(source, s)) and len(got) > 30
    assert not [name for name, _ in _nodes(x) if "Exchange" in name]


def test_overrides_of_a_large_file(spark):
    """Many methods of one class, many classes of one base, many bases of one class: no pairs are made of them."""
    n = 3000
    s = lambda k, kind, name, cls, above: F.struct(k.cast("int").alias("sym_seq"), F.lit(kind).alias("kind"), name.alias("name"), cls.cast("string").alias("parent_class"), above.cast("array<string>").alias("base_classes"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    name = lambda a, i: F.concat(F.lit(a), i.cast("string"))
    none, nobody = F.array(), F.lit(None)
    symbols = F.concat(
        F.array(s(F.lit(0), "class", F.lit("A"), nobody, none), s(F.lit(1), "class", F.lit("B"), nobody, F.concat(F.array(F.lit("A")), each(lambda i: name("K", i))))),
        each(lambda i: s(i, "method", name("m", i), F.lit("A"), none)), each(lambda i: s(i + n, "method", name("m", i), F.lit("B"), none)),
        each(lambda i: s(i + 2 * n, "class", name("K", i), nobody, F.array(F.lit("A")))), each(lambda i: s(i + 3 * n, "method", F.lit("m0"), name("K", i), none)),
    )
    df = spark.range(1).select(F.lit("j").alias("job_id"), F.lit("a.py").alias("path"), F.lit(0).cast("long").alias("file_seq"), F.lit("def m():\n  pass").alias("source"), symbols.alias("symbols"))
    got = {r.symbol for r in design.lsp(df).collect()}
    assert got == {f"B.m{i}" for i in range(n)} | {f"K{i}.m0" for i in range(n)}
