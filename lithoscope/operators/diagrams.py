"""Diagrams as tables: nodes (job_id, diagram, position, id, type, label, data) and
edges (job_id, diagram, position, id, source, target, label, type, data).

`data` is a map of strings.  A diagram keeps its first 300 nodes and the edges between
them; `truncated` says whether it lost any."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.udf import arrow_function, pandas_function

TYPES = ("folder_tree", "module_dependency", "package_dependency", "call_graph", "class_diagram", "architecture_diagram", "component_diagram", "er_diagram", "api_flow", "deployment_diagram", "sequence_diagram", "data_flow_diagram")
COMPOSE = ("docker-compose.yml", "docker-compose.yaml")
# fixed values: layers of the data flow
LAYERS = (
    ("input", "API / Controllers", ("controllers", "controller", "routes", "route", "api", "handlers")),
    ("business", "Services / Business Logic", ("services", "service", "usecases", "use_cases", "domain")),
    ("data", "Repositories / Data Access", ("repositories", "repository", "dao", "models", "model")),
)


def _data(**kv: Column | str) -> Column:
    items = [x for k, v in kv.items() for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("string"))]
    return F.create_map(*items) if items else F.create_map().cast("map<string,string>")


def _node(df: DataFrame, diagram: str, id_: Column | str, kind: Column | str, label: Column | str, order: Column, data: Column | None = None) -> DataFrame:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("job_id", F.lit(diagram).alias("diagram"), order.alias("o"), c(id_).alias("id"), c(kind).alias("type"), c(label).alias("label"), (_data() if data is None else data).alias("data"))


def _edge(df: DataFrame, diagram: str, source: Column | str, target: Column | str, label: Column | str, kind: str, order: Column, data: Column | None = None) -> DataFrame:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    s, t, l = c(source), c(target), c(label)
    return df.select("job_id", F.lit(diagram).alias("diagram"), order.alias("o"), F.concat(s, F.lit("->"), t, F.when(l != "", F.concat(F.lit(":"), l)).otherwise("")).alias("id"), s.alias("source"), t.alias("target"), l.alias("label"), F.lit(kind).alias("type"), (_data() if data is None else data).alias("data"))


def _o(*parts) -> Column:
    """An order key of one shape for all diagrams."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    a = [c.cast("long") for c in cols[:3]] + [F.lit(0).cast("long")] * (3 - len(cols[:3]))
    s = cols[3].cast("string") if len(cols) > 3 else F.lit("")
    return F.struct(*[x.alias(f"o{i}") for i, x in enumerate(a)], s.alias("o3"))


def cap(nodes: DataFrame, edges: DataFrame, most: int = V.MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """Numbered nodes and edges; edges lose their place with either end."""
    # Of nodes that share an id each is kept: ids are the caller's matter.
    n = nodes.withColumn("position", F.row_number().over(W.partitionBy("job_id", "diagram").orderBy("o", "id"))).withColumn("truncated", F.count("*").over(W.partitionBy("job_id", "diagram")) > most).where(F.col("position") <= most)
    ids = n.select("job_id", "diagram", "id").distinct()
    e = edges
    for end in ("source", "target"):
        e = e.join(ids.withColumnRenamed("id", end), ["job_id", "diagram", end], "left_semi")
    e = e.withColumn("position", F.row_number().over(W.partitionBy("job_id", "diagram").orderBy("o", "id")))
    return n.select("job_id", "diagram", "position", "id", "type", "label", "data", "truncated"), e.select("job_id", "diagram", "position", "id", "source", "target", "label", "type", "data")


def folder_tree(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = "folder_tree"
    node_id = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    kind = F.when(F.col("type") == "dir", "folderNode").otherwise("fileNode")
    data = F.when(F.col("type") == "dir", _data(file_count="file_count", primary_language="language")).otherwise(_data(language="language", loc="loc"))
    n = _node(tree, d, node_id, kind, F.when(F.col("name") == "", "/").otherwise(F.col("name")), _o(F.col("position")), data)
    up = F.when(F.col("parent_path") == "", "/").otherwise(F.col("parent_path"))
    return n, _edge(tree.where("parent_path IS NOT NULL"), d, up, node_id, "", "default", _o(F.col("position")))


def module_dependency(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and packages; of parallel imports one edge."""
    d = "module_dependency"
    x = nodes.where(F.col("type").isin("file", "external_package"))
    file = F.col("type") == "file"
    n = _node(x, d, F.col("id"), F.when(file, "fileNode").otherwise("packageNode"), F.when(file, T.basename("id")).otherwise(F.col("name")), _o(F.col("first.file_seq"), F.col("first.seq"), 0, F.col("id")), F.when(file, _data(path="id", language="language")).otherwise(_data()))
    e = edges.where("type = 'imports'").groupBy("job_id", "source", "target").agg(F.min(F.struct("file_seq", "seq")).alias("at"))
    return n, _edge(e, d, F.col("source"), F.col("target"), "", "imports", _o(F.col("at.file_seq"), F.col("at.seq")))


def package_dependency(nodes: DataFrame, edges: DataFrame, app: str = "Application") -> tuple[DataFrame, DataFrame]:
    """The application and its external packages, weighted by import edges."""
    d = "package_dependency"
    w = edges.where("type = 'imports'").where(F.startswith("target", F.lit("external::"))).groupBy("job_id", "target").agg(F.count("*").alias("importers"), F.min(F.struct("file_seq", "seq")).alias("at"))
    order = _o(F.col("at.file_seq"), F.col("at.seq"), 0, F.col("target"))
    jobs = nodes.select("job_id").distinct()
    n = _node(jobs, d, "app", "appNode", app, _o(-1)).unionByName(_node(w, d, F.col("target"), "packageNode", F.substring("target", 11, 10_000), order, _data(importer_count="importers")))
    return n, _edge(w, d, "app", F.col("target"), F.concat(F.col("importers").cast("string"), F.lit(" file(s)")), "default", order)


def call_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = "call_graph"
    c = edges.where("type = 'calls'")
    ends = c.select("job_id", F.col("source").alias("id")).union(c.select("job_id", F.col("target").alias("id"))).distinct()
    x = nodes.join(ends, ["job_id", "id"], "left_semi")
    n = _node(x, d, F.col("id"), "functionNode", F.coalesce("name", "id"), _o(F.col("first.file_seq"), F.col("first.seq"), 0, F.col("id")), _data(file="file", parent_class="parent_class", complexity="complexity"))
    return n, _edge(c, d, F.col("source"), F.col("target"), "", "calls", _o(F.col("file_seq"), F.col("seq")))


def class_diagram(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes with their sorted method names, and who inherits from whom."""
    d = "class_diagram"
    methods = edges.where("type = 'defines'").join(nodes.where("type = 'method'").select("job_id", F.col("id").alias("target"), "name"), ["job_id", "target"]).groupBy("job_id", F.col("source").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("methods"))
    x = nodes.where("type = 'class'").join(methods, ["job_id", "id"], "left")
    none = F.array().cast("array<string>")
    n = _node(x, d, F.col("id"), "classNode", F.col("name"), _o(F.col("first.file_seq"), F.col("first.seq"), 0, F.col("id")), _data(file="file", methods=F.to_json(F.coalesce("methods", none)), base_classes=F.to_json(F.coalesce("base_classes", none))))
    return n, _edge(edges.where("type = 'inherits'"), d, F.col("source"), F.col("target"), "inherits", "inherits", _o(F.col("file_seq"), F.col("seq")))


def component_of(path: str, depth: int) -> Column:
    c = F.array_join(F.slice(T.dirs(path), 1, depth), "/")
    return F.when(c == "", "(root)").otherwise(c)


def components(files: DataFrame, depth: int) -> DataFrame:
    return files.groupBy("job_id", component_of("path", depth).alias("component")).agg(F.count("*").alias("file_count"), F.min("file_seq").alias("first"))


def component_edges(edges: DataFrame, depth: int) -> DataFrame:
    """Weights of imports between different components, files to files only."""
    x = edges.where("type = 'imports'").where(~F.startswith("target", F.lit("external::")))
    x = x.select("job_id", component_of("source", depth).alias("u"), component_of("target", depth).alias("v"), "file_seq", "seq").where("u <> v")
    return x.groupBy("job_id", "u", "v").agg(F.count("*").alias("weight"), F.min(F.struct("file_seq", "seq")).alias("at"))


def component_diagram(files: DataFrame, edges: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    d = "architecture_diagram" if depth == 1 else "component_diagram"
    n = _node(components(files, depth), d, F.col("component"), "componentNode", F.col("component"), _o(F.col("first")), _data(file_count="file_count"))
    w = component_edges(edges, depth)
    return n, _edge(w, d, F.col("u"), F.col("v"), F.col("weight").cast("string"), "depends_on", _o(F.col("at.file_seq"), F.col("at.seq")), _data(weight="weight"))


def er_diagram(tables: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = "er_diagram"
    n = _node(tables, d, F.col("name"), "tableNode", F.col("name"), _o(F.col("file_seq"), F.col("seq")), _data(orm="orm", file="file", columns=F.to_json("columns")))
    return n, _edge(relations.where("from <> to"), d, F.col("from"), F.col("to"), F.col("via"), "relationship", _o(F.col("file_seq"), F.col("seq"), F.col("pos")))


def api_flow(jobs: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Client to endpoint to file, endpoints numbered from 0."""
    d = "api_flow"
    e = endpoints.withColumn("i", F.row_number().over(W.partitionBy("job_id").orderBy("file_seq", "file", "seq")) - 1)
    ep, fid = F.concat(F.lit("endpoint::"), F.col("i").cast("string")), F.concat(F.lit("file::"), F.col("file"))
    n = [_node(jobs, d, "client", "clientNode", "Client", _o(-1)), _node(e, d, ep, "endpointNode", F.concat_ws(" ", "method", "path"), _o(F.col("i"), 0), _data(framework="framework"))]
    n.append(_node(e.groupBy("job_id", "file").agg(F.min("i").alias("i")), d, fid, "fileNode", F.col("file"), _o(F.col("i"), 1)))
    edges = _edge(e, d, "client", ep, "", "request", _o(F.col("i"), 0)).unionByName(_edge(e, d, ep, fid, F.concat(F.lit("line "), F.col("line").cast("string")), "handled_by", _o(F.col("i"), 1)))
    return reduce(DataFrame.unionByName, n), edges


def outline(source: str) -> list[tuple[int, str, str]]:
    """The lines of an indented file as (parent, key, value): the parent is the last line
    that is indented less, -1 for none.  A list item stands below the key at its own
    indent; comments and blank lines are not there."""
    rows, above = [], []
    for line in source.splitlines():
        text = line.strip()
        if text and not text.startswith("#"):
            at = 2 * (len(line) - len(line.lstrip())) + text.startswith("- ")
            above = [(i, n) for i, n in above if i < at]
            key, _, value = text.partition(":")
            rows.append((above[-1][1] if above else -1, key.strip("\"'"), value.split(" #")[0].strip()))
            above.append((at, len(rows) - 1))
    return rows


def compose_services(source: str) -> list[dict]:
    """Services of a compose file: name, image, depends_on (as a list or as a map)."""
    rows, bare = outline(source or ""), lambda x: x.strip().strip("\"'")
    below = lambda parent: [(n, key, value) for n, (p, key, value) in enumerate(rows) if p == parent]
    found = {}
    for top in (n for n, key, _ in below(-1) if key == "services"):
        for n, name, value in below(top):
            if not value:
                parts = {key: (m, value) for m, key, value in below(n)}
                m, listed = parts.get("depends_on", (None, ""))
                deps = listed.strip("[]").split(",") if listed else [key.removeprefix("- ") for _, key, _ in below(m)] if m is not None else []
                found[name] = {"name": name, "image": bare(parts["image"][1]) if "image" in parts else None, "depends_on": [d for d in map(bare, deps) if d]}
    return list(found.values())


@pandas_function("array<struct<name:string,image:string,depends_on:array<string>>>")
def _services(source: pd.Series) -> pd.Series:
    return source.map(compose_services)


def deployment(jobs: DataFrame, sources: DataFrame, tables: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The services of a job's first compose file, else client, application, database."""
    d = "deployment_diagram"
    first = sources.where(T.basename("path").isin(*COMPOSE)).groupBy("job_id").agg(F.min_by("source", F.struct("file_seq", "path")).alias("source"))
    s = first.select("job_id", F.posexplode(_services("source")).alias("i", "s")).select("job_id", "i", "s.*")
    n = _node(s, d, F.col("name"), "serviceNode", F.col("name"), _o(F.col("i")), _data(image="image"))
    deps = s.select("job_id", "i", "name", F.posexplode("depends_on").alias("k", "dep"))
    e = _edge(deps.join(s.select("job_id", F.col("name").alias("dep")), ["job_id", "dep"], "left_semi"), d, F.col("name"), F.col("dep"), "", "depends_on", _o(F.col("i"), F.col("k")))
    rest = jobs.join(s.select("job_id").distinct(), "job_id", "left_anti")
    rest = rest.join(tables.groupBy("job_id").agg(F.array_sort(F.collect_set("orm")).alias("orms")), "job_id", "left").join(endpoints.select("job_id", F.lit(True).alias("api")).distinct(), "job_id", "left")
    db = rest.where("orms IS NOT NULL")
    fn = [_node(rest, d, "client", "clientNode", "Client", _o(0)), _node(rest, d, "app", "serviceNode", "Application", _o(1)), _node(db, d, "database", "databaseNode", "Database", _o(2), _data(orms=F.to_json("orms")))]
    fe = [_edge(rest, d, "client", "app", F.when(F.col("api"), "requests").otherwise(""), "default", _o(0)), _edge(db, d, "app", "database", "reads/writes", "default", _o(1))]
    return reduce(DataFrame.unionByName, [n, *fn]), reduce(DataFrame.unionByName, [e, *fe])


def data_flow(files: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Client, the layers that have a folder, and a database if there are tables."""
    d = "data_flow_diagram"
    x = files.groupBy("job_id").agg(F.array_distinct(F.flatten(F.collect_set(F.transform(T.dirs("path"), lambda s: F.lower(s))))).alias("f"))
    x = x.join(tables.select("job_id", F.lit(True).alias("db")).distinct(), "job_id", "left")
    step = lambda i, k, l: F.struct(F.lit(k).alias("id"), F.lit(i).alias("type"), F.lit(l).alias("label"))
    layers = F.array_compact(F.array(*[F.when(F.arrays_overlap("f", F.array(*[F.lit(n) for n in names])), step("processNode", k, l)) for k, l, names in LAYERS]))
    middle = F.when(F.size(layers) > 0, layers).otherwise(F.array(step("processNode", "app", "Application")))
    chain = F.concat(F.array(step("clientNode", "client", "Client")), middle, F.when(F.col("db"), F.array(step("databaseNode", "database", "Database"))).otherwise(F.slice(middle, 1, 0)))
    y = x.select("job_id", chain.alias("c"))
    n = y.select("job_id", F.posexplode("c").alias("i", "s"))
    e = y.select("job_id", F.posexplode(F.transform(F.slice("c", F.lit(2), F.size("c") - 1), lambda s, i: F.struct(F.get(F.col("c"), i)["id"].alias("u"), s["id"].alias("v")))).alias("i", "s"))
    return _node(n, d, F.col("s.id"), F.col("s.type"), F.col("s.label"), _o(F.col("i"))), _edge(e, d, F.col("s.u"), F.col("s.v"), "", "default", _o(F.col("i")))


def handlers(endpoints: DataFrame, functions: DataFrame, width: int = 16) -> DataFrame:
    """Each endpoint's function: the nearest of those around its line, else of those that
    begin within three lines.

    The answer depends on the line alone, and of functions with one span only the first
    can be it: lines and spans are made distinct before they meet, so that no key has more
    rows than a file has lines.  Most endpoints lie in a function that begins within three
    lines before them, which an equi-join on the line finds.  For the others a span is
    repeated for each stretch of `width` lines that it may answer for, and joined by
    stretch."""
    cols, at = ["job_id", "path", "method", "route", "line", "flow"], ["job_id", "path", "line"]
    e = endpoints.select("job_id", F.col("file").alias("path"), "method", F.col("path").alias("route"), "line", "flow").distinct()
    asked = e.select(at).distinct()
    # one filter for both joins, so that the spans are made once
    known = functions.where("job_id IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
    f = known.groupBy("job_id", "path", "start_line", "end_line").agg(F.min(F.struct("sym_seq", "name", "parent_class")).alias("f"))
    inside = (F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line") + 5)
    gap = F.abs(F.col("start_line") - F.col("line"))
    best = F.min(F.struct((~inside).cast("int").alias("o"), gap.alias("g"), "f")).alias("h")
    near = asked.withColumn("start_line", F.explode(F.sequence(F.col("line") - 3, F.col("line")))).join(f, ["job_id", "path", "start_line"]).where(inside).groupBy(at).agg(best)
    rest = asked.join(near.select(at), at, "left_anti").withColumn("_w", F.floor(F.col("line") / width))
    reach = F.sequence(F.floor((F.col("start_line") - 3) / width), F.floor(F.greatest(F.col("end_line") + 5, F.col("start_line") + 3) / width))
    wide = rest.join(f.withColumn("_w", F.explode(reach)), ["job_id", "path", "_w"]).where(inside | (gap <= 3)).groupBy(at).agg(best)
    return e.join(near.unionByName(wide), at).select(*cols, "h.f.name", "h.f.parent_class")


def shown_methods(nodes: DataFrame, most: int = 10) -> DataFrame:
    """Nodes of the class diagram with the methods that are shown, and how many more there are."""
    m = F.coalesce(F.from_json(F.col("data")["methods"], "array<string>"), F.array().cast("array<string>"))
    return nodes.select("job_id", "id", F.slice(m, 1, most).alias("shown"), F.greatest(F.lit(0), F.size(m) - most).alias("more"))


def walk(start: str, calls: dict[str, list[str]], depth: int = V.FLOW_DEPTH) -> list[tuple[str, str, int]]:
    """(from, to, step) depth first; a function is entered once."""
    out, seen = [], {start}

    def go(node: str, level: int):
        if level < depth:
            for t in calls.get(node, ()):
                if t not in seen:
                    seen.add(t)
                    out.append((node, t, level + 2))
                    go(t, level + 1)

    go(start, 0)
    return out


@arrow_function("array<struct<source:string,target:string,step:int>>")
def walked(start: pa.Array, calls: pa.Array) -> pa.Array:
    """The walk of each row.  Only one row's calls are Python's objects at a time, and steps
    go back to Arrow every few rows."""
    kind = pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("step", pa.int32())]))
    done, out = [], []
    for s, rows in zip(start, calls, strict=True):
        by: dict[str, list[str]] = {}
        if rows.is_valid:
            for a, b in zip(*(rows.values.field(i).to_pylist() for i in range(2)), strict=True):
                by.setdefault(a, []).append(b)
        out.append([{"source": a, "target": b, "step": n} for a, b, n in walk(s.as_py(), by)])
        if len(out) == 100:
            done.append(pa.array(out, kind))
            out = []
    return pa.concat_arrays([*done, pa.array(out, kind)])


def sequence(endpoints: DataFrame, functions: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first three endpoints of a job: client, handler, and the calls it leads to.

    The calls within reach of the handlers are found with joins, four levels deep; only
    that small neighbourhood goes to the depth-first walk, which no join can express."""
    d = "sequence_diagram"
    e = endpoints.withColumn("flow", F.row_number().over(W.partitionBy("job_id").orderBy("file_seq", "file", "seq")) - 1).where(F.col("flow") < V.MAX_FLOWS)
    h = handlers(e, functions).withColumn("start", T.symbol_id("path", "name", "parent_class"))
    calls = edges.where("type = 'calls'").groupBy("job_id", "source", "target").agg(F.min(F.struct("file_seq", "seq")).alias("at"))
    reach = h.select("job_id", "flow", F.col("start").alias("source"))
    near = None
    for _ in range(V.FLOW_DEPTH):
        step = calls.join(reach.distinct(), ["job_id", "source"])
        near = step if near is None else near.unionByName(step)
        reach = step.select("job_id", "flow", F.col("target").alias("source"))
    near = near.groupBy("job_id", "flow", "source", "target").agg(F.min("at").alias("at"))
    packed = near.groupBy("job_id", "flow").agg(F.array_sort(F.collect_list(F.struct("source", "at", "target"))).alias("c"))

    f = h.join(packed, ["job_id", "flow"], "left").withColumn("w", walked("start", F.transform("c", lambda c: F.struct(c["source"], c["target"]))))
    pre = F.concat(F.lit("seq"), F.col("flow").cast("string"), F.lit("::"))
    client, own = F.concat(pre, F.lit("client")), F.concat(pre, F.col("start"))
    title = F.concat(F.col("method"), F.lit(" "), F.col("route"), F.lit(" → "), F.col("name"))
    steps = f.select("job_id", "flow", F.posexplode("w").alias("i", "s"))
    named = steps.select("job_id", "flow", "i", F.col("s.target").alias("id")).join(nodes.select("job_id", "id", "name"), ["job_id", "id"], "left")
    n = [_node(f, d, client, "participantNode", "Client", _o(F.col("flow"), -2), _data(flow="flow")), _node(f, d, own, "participantNode", title, _o(F.col("flow"), -1), _data(flow="flow")), _node(named, d, F.concat(pre, F.col("id")), "participantNode", F.coalesce("name", "id"), _o(F.col("flow"), F.col("i")), _data(flow="flow"))]
    g = [_edge(f, d, client, own, "1", "call", _o(F.col("flow"), -1)), _edge(steps, d, F.concat(pre, F.col("s.source")), F.concat(pre, F.col("s.target")), F.col("s.step").cast("string"), "call", _o(F.col("flow"), F.col("i")))]
    return reduce(DataFrame.unionByName, n), reduce(DataFrame.unionByName, g)
