"""Endpoints, protocols and authentication of a repository's API."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

_MARK = "\x01"


def endpoints(sources: DataFrame) -> DataFrame:
    """job_id, method, path, file, line, framework, file_seq, seq: one row per match.

    A mark is put before each match of a pattern, the text is cut at the marks, and the
    line ends before a cut give its line: regex functions tell no offsets, and a match
    may span lines.  Each cut is matched again from its start."""
    out = []
    for n, (framework, method, pattern, path_group) in enumerate(V.ROUTES):
        p = T.rx(pattern)
        again = T.rx("^" + pattern.replace(r"(?<!@)\b", ""))  # what stood before the cut was tested when it was made
        clean = F.translate("source", _MARK, " ")
        x = sources.where(T.has("source", pattern)).select("job_id", "file_seq", F.col("path").alias("file"), F.split(F.regexp_replace(clean, p, _MARK + "$0"), _MARK).alias("c"))
        ends = F.transform("c", lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))))
        x = x.select("job_id", "file_seq", "file", "c", ends.alias("e")).select("job_id", "file_seq", "file", F.posexplode("c").alias("i", "s"), "e").where("i > 0")
        line = F.aggregate(F.slice("e", F.lit(1), F.col("i")), F.lit(1), lambda a, b: a + b)
        verb = F.lit(method) if isinstance(method, str) else F.upper(F.regexp_extract("s", again, method))
        path = T.strip(F.regexp_extract("s", again, path_group))
        out.append(x.select("job_id", F.when(verb == "", "GET").otherwise(verb).alias("method"), F.when(path == "", "(dynamic)").otherwise(path).alias("path"), "file", line.cast("int").alias("line"), F.lit(framework).alias("framework"), "file_seq", (F.lit(n * 100_000) + F.col("i")).alias("seq")))
    return reduce(DataFrame.unionByName, out)


def protocols(endpoints: DataFrame, sources: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """job_id, protocols (sorted)."""
    low = F.lower("raw")
    p = lambda df, c: df.select("job_id", c.alias("p"))
    parts = [
        p(endpoints, F.when(F.col("method") == "WEBSOCKET", "WebSocket").otherwise("REST")),
        p(sources, F.when(F.col("path").endswith(".graphql") | F.col("path").endswith(".gql"), "GraphQL").when(F.col("path").endswith(".proto"), "gRPC")),
        p(symbols, F.when((F.col("kind") == "class") & F.col("name").isin("Query", "Mutation", "Resolver") | F.exists("decorators", lambda d: d.contains("@Resolver") | d.contains("@Query") | d.contains("@Mutation")), "GraphQL")),
        p(imports, F.when(low.isin(*V.GRAPHQL_IMPORTS), "GraphQL").when(low.isin(*V.GRPC_IMPORTS), "gRPC").when(low.isin(*V.WEBSOCKET_IMPORTS), "WebSocket")),
    ]
    return reduce(DataFrame.union, parts).where("p IS NOT NULL").groupBy("job_id").agg(F.array_sort(F.collect_set("p")).alias("protocols"))


def auth(sources: DataFrame, imports: DataFrame) -> DataFrame:
    """job_id, mechanisms (sorted): those of imports and those of markers in sources."""
    low = F.lower("raw")
    has = lambda *names: F.bool_or(low.isin(*names))
    i = imports.groupBy("job_id").agg(
        F.when(has("jwt", "pyjwt", "jsonwebtoken"), "JWT").alias("a"), F.when(has("passport", "passport-jwt"), "Passport.js").alias("b"), F.when(F.bool_or(low.isin("oauthlib", "authlib") | low.contains("oauth")), "OAuth").alias("c"),
        F.when(has("django.contrib.auth"), "Django auth").alias("d"), F.when(has("flask_login", "flask-login"), "Flask-Login").alias("e"), F.when(F.bool_or(low.contains("spring-security") | low.contains("springframework.security")), "Spring Security").alias("f"),
    )
    marks = lambda *ms: F.bool_or(reduce(lambda x, y: x | y, [F.contains("source", F.lit(m)) for m in ms]))
    s = sources.groupBy("job_id").agg(
        F.when(marks("HTTPBearer", "OAuth2PasswordBearer"), "OAuth2/Bearer token").alias("a"), F.when(marks("@UseGuards"), "NestJS guards").alias("b"), F.when(marks("[Authorize]"), "ASP.NET [Authorize]").alias("c"),
        F.when(marks("@login_required", "@jwt_required"), "Flask decorator-based auth").alias("d"),
    )
    both = i.select("job_id", F.explode(F.array_compact(F.array(*"abcdef"))).alias("m")).union(s.select("job_id", F.explode(F.array_compact(F.array(*"abcd"))).alias("m")))
    return both.groupBy("job_id").agg(F.array_sort(F.collect_set("m")).alias("mechanisms"))


def detect_api_surface(sources: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One row a job: protocols, endpoint_count, auth_detected, mechanisms."""
    e = endpoints(sources)
    none = F.array().cast("array<string>")
    x = sources.select("job_id").distinct().join(protocols(e, sources, symbols, imports), "job_id", "left").join(e.groupBy("job_id").agg(F.count("*").alias("endpoint_count")), "job_id", "left").join(auth(sources, imports), "job_id", "left")
    return x.select("job_id", F.coalesce("protocols", none).alias("protocols"), F.coalesce("endpoint_count", F.lit(0)).alias("endpoint_count"), F.col("mechanisms").isNotNull().alias("auth_detected"), F.coalesce("mechanisms", none).alias("mechanisms"))
