"""Design patterns and SOLID violations, by names, methods and bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .findings import with_method_counts
from .parsing import Code


def _overlap(names: tuple) -> Column:
    return F.array_intersect("method_names", F.array(*[F.lit(n) for n in names]))


def _match(df: DataFrame, pattern: str, reason: Column | str, n: int = 0, symbol: str | None = "name", line: str | None = "start_line") -> DataFrame:
    r = F.lit(reason) if isinstance(reason, str) else reason
    s = (F.col(symbol) if symbol else F.lit(None)).cast("string").alias("symbol")
    return df.select("job_id", F.lit(pattern).alias("pattern"), F.col("path").alias("file"), s, (F.col(line) if line else F.lit(0)).cast("int").alias("line"), r.alias("reason"), "file_seq", (F.coalesce(F.col("sym_seq") if "sym_seq" in df.columns else F.lit(None), F.lit(99_999)) * 20 + n).cast("long").alias("seq"))


def subclass_counts(classes: DataFrame) -> DataFrame:
    return classes.select("job_id", F.explode("base_classes").alias("b")).groupBy("job_id", T.last_part(F.col("b")).alias("name")).agg(F.count("*").alias("subclasses"))


def class_patterns(counted: DataFrame) -> DataFrame:
    """counted: classes with method_names, body and subclasses.  All rules are evaluated
    in one pass over the classes and the hits exploded."""
    name = F.col("name")
    q = F.concat(F.lit("'"), name, F.lit("'"))
    says = lambda a, b="": F.concat(F.lit(a), q, F.lit(b))
    ends = lambda p: F.rlike(name, F.lit(p + "$"))
    listed = lambda c: F.array_join(F.array_sort(c), ", ")
    text = F.array_join("body", "\n")
    crud, pub = _overlap(V.CRUD), _overlap(V.PUBSUB)
    observer = ends("(Observer|Listener|Subscriber)")
    rules = [
        ("Factory", ends("Factory"), says("class name ", " follows the *Factory naming convention")),
        ("Builder", ends("Builder") & F.array_contains("method_names", "build"), says("class name ", " ends in Builder and defines a build() method")),
        ("Repository", ends("(Repository|Repo)") & (F.size(crud) >= 2), F.concat(says("class name ", " ends in Repository/Repo and exposes CRUD-style methods ("), listed(crud), F.lit(")"))),
        ("Singleton", F.contains(text, F.lit("_instance")) & T.has(text, r"\b(instance|getInstance|get_instance)\b"), says("class ", " holds a private instance reference with an instance accessor")),
        ("Strategy", ends("Strategy") | (F.col("subclasses") >= 2), F.when(ends("Strategy"), says("class name ", " follows the *Strategy naming convention")).otherwise(F.concat(q, F.lit(" has "), F.col("subclasses").cast("string"), F.lit(" distinct subclasses — likely an interchangeable-implementation (Strategy) role")))),
        ("Adapter", ends("(Adapter|Wrapper)"), says("class name ", " follows the *Adapter/*Wrapper naming convention")),
        ("Facade", ends("Facade"), says("class name ", " follows the *Facade naming convention")),
        ("Observer", observer | (F.size(pub) >= 2), F.when(observer, says("class name ", " follows the *Observer/*Listener convention")).otherwise(F.concat(q, F.lit(" exposes pub/sub-style methods ("), listed(pub), F.lit(")")))),
        ("Decorator", ends("Decorator"), says("class name ", " follows the *Decorator naming convention")),
        ("Command", ends("Command") & (F.size(_overlap(("execute", "run", "handle"))) > 0), says("class name ", " ends in Command and defines an execute/run/handle method")),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("n"), F.lit(p).alias("pattern"), r.alias("reason"))) for i, (p, c, r) in enumerate(rules)]))
    x = counted.select("job_id", "path", "file_seq", "sym_seq", "name", "start_line", F.explode(hits).alias("h"))
    return x.select("job_id", "h.pattern", F.col("path").alias("file"), F.col("name").alias("symbol"), F.col("start_line").alias("line"), "h.reason", "file_seq", (F.col("sym_seq") * 20 + F.col("h.n")).cast("long").alias("seq"))


def factory_functions(functions: DataFrame) -> DataFrame:
    x = functions.where((F.col("kind") == "function") & F.rlike(F.lower("name"), F.lit("^(create_|make_|build_)")) & (F.col("complexity") > 2))
    return _match(x, "Factory", F.format_string("function '%s' has a create/make/build name and branches (%d paths) to produce different results", "name", "complexity"), 15)


def injections(sources: DataFrame) -> DataFrame:
    x = sources.where(reduce(lambda a, b: a | b, [F.contains("source", F.lit(m)) for m in V.DI_MARKERS]))
    return _match(x, "Dependency Injection", "dependency-injection framework marker found (Depends/@Autowired/@Inject/@Injectable)", 0, None, None)


def cqrs(classes: DataFrame) -> DataFrame:
    kind = F.when(F.rlike("name", F.lit("Command$")), "c").when(F.rlike("name", F.lit("Query$")), "q").when(F.rlike("name", F.lit("Handler$")), "h")
    x = classes.withColumn("k", kind).where("k IS NOT NULL")
    at = F.struct("file_seq", "sym_seq", "path", "name", "start_line")
    n = lambda k: F.count_if(F.col("k") == k)
    g = x.groupBy("job_id").agg(n("c").alias("c"), n("q").alias("q"), n("h").alias("h"), F.coalesce(F.min(F.when(F.col("k") == "c", at)), F.min(F.when(F.col("k") == "q", at))).alias("a"))
    g = g.where("c + q >= 2 AND h >= 2").select("job_id", "c", "q", "h", "a.path", "a.name", "a.start_line", F.lit(1 << 61).alias("file_seq"))
    return _match(g, "CQRS", F.format_string("repo defines %d Command class(es), %d Query class(es), and %d Handler class(es) — command/query separation with dedicated handlers", "c", "q", "h"))


def detect_patterns(code: Code) -> DataFrame:
    """job_id, pattern, file, symbol, line, reason, file_seq, seq."""
    bodies = code.bodies.where("kind = 'class'").select("job_id", "path", "sym_seq", "body")
    counted = with_method_counts(code).join(bodies, ["job_id", "path", "sym_seq"], "left").join(subclass_counts(code.classes), ["job_id", "name"], "left")
    return reduce(DataFrame.unionByName, [class_patterns(counted), factory_functions(code.functions), injections(code.sources), cqrs(code.classes)])


# --- SOLID -------------------------------------------------------------------


def _violation(df: DataFrame, principle: str, symbol: Column, message: Column) -> DataFrame:
    return df.select("job_id", F.lit(principle).alias("principle"), F.col("path").alias("file"), symbol.alias("symbol"), F.col("start_line").cast("int").alias("line"), message.alias("message"), "file_seq", F.col("sym_seq").cast("long").alias("seq"))


def srp(counted: DataFrame) -> DataFrame:
    x = counted.withColumn("_n", F.col("end_line") - F.col("start_line") + 1).where((F.col("methods") > V.SRP_METHODS) | (F.col("_n") > V.SRP_LOC))
    return _violation(x, "SRP", F.col("name"), F.format_string("'%s' has %d methods across %d lines — likely handling more than one responsibility", "name", "methods", "_n"))


def isp(counted: DataFrame) -> DataFrame:
    x = counted.where(F.rlike("name", F.lit("^I[A-Z]")) & (F.col("methods") > V.ISP_METHODS))
    return _violation(x, "ISP", F.col("name"), F.format_string("interface '%s' declares %d methods — implementers are forced to depend on methods they may not use", "name", "methods"))


def ocp(bodies: DataFrame) -> DataFrame:
    x = bodies.where("kind <> 'class'").withColumn("_n", F.size(F.filter("body", lambda l: F.rlike(l, F.lit(T.rx(V.TYPE_SWITCH)))))).where("_n >= 3")
    return _violation(x, "OCP", F.col("name"), F.format_string("'%s' branches %d times on a type/kind/status field — adding a new case means editing this function; consider polymorphism instead", "name", "_n"))


def _runs(rows: Column) -> Column:
    """The structs of an array, sorted, in arrays of those whose first field, `key`, is equal."""

    def cut(a):
        starts = F.filter(F.transform(a, lambda _, i: i), lambda i: (i == 0) | ~F.get(a, i)["key"].eqNullSafe(F.get(a, i - 1)["key"]))
        return T.let(starts, lambda s: F.transform(s, lambda i, n: F.slice(a, i + 1, F.coalesce(F.get(s, n + 1), F.size(a)) - i)))

    return T.let(F.sort_array(rows), cut)


def _members(symbols: Column) -> Column:
    """name, bases, methods and their names, of a file's classes.  Of classes with one name the first gives the
    bases; of methods the last counts."""
    is_class = lambda s: s["kind"] == "class"
    own = F.filter(symbols, lambda s: (is_class(s) | (s["parent_class"] != "")) & s["name"].isNotNull())
    rows = F.transform(own, lambda s: F.struct(F.when(is_class(s), s["name"]).otherwise(s["parent_class"]).alias("key"), (~is_class(s)).alias("is_method"), s["name"].alias("name"), s["sym_seq"].alias("sym_seq"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), s["base_classes"].alias("bases")))

    def member(r):
        bases = F.array_distinct(F.transform(F.coalesce(F.get(r, F.lit(0))["bases"], F.array().cast("array<string>")), T.last_part))
        last = F.filter(r, lambda m, i: m["is_method"] & ~F.get(r, i + 1)["name"].eqNullSafe(m["name"]))
        methods = F.transform(last, lambda m: F.struct(m["key"].alias("cls"), m["name"].alias("method"), m["sym_seq"].alias("sym_seq"), m["start_line"].alias("start_line"), m["end_line"].alias("end_line")))
        return F.struct(F.get(r, F.lit(0))["key"].alias("name"), bases.alias("bases"), methods.alias("methods"), F.transform(last, lambda m: m["name"]).alias("names"))

    return F.transform(F.filter(_runs(rows), lambda r: ~F.get(r, F.lit(0))["is_method"]), member)


def overrides(symbols: Column) -> Column:
    """cls, method, sym_seq, start_line, end_line: the methods of a file that a base class in the
    file has too.  Classes meet their bases as neighbours in a sorted array, methods their names
    as keys of maps: nothing is shuffled, and what is held at once is a part of the file's row."""

    def of(cs):
        asked = F.flatten(F.transform(cs, lambda c, i: F.transform(c["bases"], lambda b: F.struct(b.alias("key"), i.alias("by"), i.alias("at")))))
        met = F.filter(_runs(F.concat(F.transform(cs, lambda c, i: F.struct(c["name"].alias("key"), F.lit(-1).alias("by"), i.alias("at"))), asked)), lambda r: F.get(r, F.lit(0))["by"] == -1)
        pairs = F.flatten(F.transform(met, lambda r: F.transform(F.slice(r, F.lit(2), F.size(r)), lambda x: F.struct(x["by"].alias("key"), F.get(r, F.lit(0))["at"].alias("base")))))

        def shared(r):
            own = F.get(cs, F.get(r, F.lit(0))["key"])
            both = F.flatten(F.transform(r, lambda x: F.array_intersect(own["names"], F.get(cs, x["base"])["names"])))
            found = T.let(F.array_distinct(both), lambda n: F.map_from_arrays(n, n))
            return F.map_values(F.map_zip_with(F.map_from_arrays(own["names"], own["methods"]), found, lambda _, m, n: F.when(n.isNotNull(), m)))

        return F.array_compact(F.flatten(F.transform(_runs(pairs), shared)))

    return T.let(_members(symbols), of)


def lsp(parsed: DataFrame) -> DataFrame:
    """Overrides, of a base class in the same file, that only raise or do nothing: all within
    the file's row."""

    def is_stub(body):
        rest = F.filter(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))), lambda l: T.strip(l) != "")
        return T.let(rest, lambda r: (F.size(r) > 0) & F.forall(r, lambda l: F.rlike(l, F.lit(T.rx(V.STUB)))))

    body = lambda ls, m: F.slice(ls, F.greatest(F.lit(1), m["start_line"]), F.greatest(F.lit(0), m["end_line"] - m["start_line"] + 1))
    stubs = T.let(T.lines("source"), lambda ls: F.filter(overrides(F.col("symbols")), lambda m: is_stub(body(ls, m))))
    x = parsed.where(F.exists("symbols", lambda s: (s["kind"] == "class") & (F.size(s["base_classes"]) > 0)))
    # Before explode() Spark would make the array once more, to see that it is not empty.
    x = x.select("job_id", "path", "file_seq", F.explode_outer(stubs).alias("m")).where("m IS NOT NULL").select("job_id", "path", "file_seq", "m.*")
    return _violation(x, "LSP", F.concat("cls", F.lit("."), "method"), F.format_string("'%s.%s' overrides a base-class method but only raises/stubs — callers substituting '%s' for its base will break", "cls", "method", "cls"))


def dip_counts(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Methods, but for constructors, that call the name of a class of the repository: the
    first such call, and `owners`, how many classes of the file bear the name of its class."""
    owners = classes.groupBy("job_id", "path", F.col("name").alias("parent_class")).agg(F.count("*").alias("owners"))
    names = classes.select("job_id", F.col("name").alias("short")).distinct()
    m = functions.where((F.col("parent_class") != "") & ~F.col("name").isin("__init__", "constructor") & (F.col("name") != F.col("parent_class")))
    c = m.select("job_id", "path", "file_seq", "sym_seq", "parent_class", "name", "start_line", F.posexplode("calls").alias("pos", "call")).withColumn("short", T.last_part(F.col("call"))).join(names, ["job_id", "short"], "left_semi")
    c = c.groupBy("job_id", "path", "file_seq", "sym_seq", "parent_class", "name", "start_line").agg(F.min_by("call", "pos").alias("call"))
    return c.join(owners, ["job_id", "path", "parent_class"])


def dip(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """A violation for each of the method's owners."""
    x = dip_counts(classes, functions).withColumn("_o", F.explode(F.sequence(F.lit(1), F.col("owners").cast("int"))))
    return _violation(x, "DIP", F.concat("parent_class", F.lit("."), "name"), F.format_string("'%s.%s' directly constructs '%s' instead of receiving it as a dependency", "parent_class", "name", "call"))


def analyze_solid(code: Code) -> DataFrame:
    """job_id, principle, file, symbol, line, message, file_seq, seq."""
    counted, bodies = with_method_counts(code), code.bodies
    return reduce(DataFrame.unionByName, [srp(counted), isp(counted), ocp(bodies), lsp(code.parsed), dip(code.classes, code.functions)])


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("job_id", column).agg(F.count("*").alias("n"))
