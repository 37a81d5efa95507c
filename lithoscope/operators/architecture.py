"""Architecture style from weighted signals in folder names, files and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

LEAST = 25


def observations(files: DataFrame, imports: DataFrame) -> DataFrame:
    """One row a job: folders and basenames (lower-case sets), services with their own
    manifest, Dockerfiles, and whether a message broker is imported."""
    x = files.withColumn("_d", T.dirs("path")).withColumn("_b", T.basename("path"))
    top = F.when((F.size("_d") > 0) & F.lower("_b").isin(*V.MANIFESTS), F.element_at("_d", 1))
    f = x.groupBy("job_id").agg(
        F.array_distinct(F.flatten(F.collect_set(F.transform("_d", lambda s: F.lower(s))))).alias("folders"), F.collect_set(F.when(F.lower("_b").isin(*_FILES), F.lower("_b"))).alias("names"),
        F.count_distinct(top).alias("services"), F.count_if(F.col("_b") == "Dockerfile").alias("dockerfiles"),
    )
    broker = imports.where(F.lower("raw").isin(*V.BROKERS)).select("job_id", F.lit(True).alias("broker")).distinct()
    return f.join(broker, "job_id", "left").withColumn("broker", F.coalesce("broker", F.lit(False)))


def _any(column: str, *names: str) -> Column:
    return F.arrays_overlap(column, F.array(*[F.lit(n) for n in names]))


_FILES = ("docker-compose.yml", "docker-compose.yaml", "serverless.yml", "template.yaml", "template.yml", "handler.py", "lambda_function.py", "index.mjs", "models.py", "views.py", "urls.py")


def _signals() -> dict[str, list[tuple[int, str, Column]]]:
    d = lambda *n: _any("folders", *n)
    f = lambda *n: _any("names", *n)
    services, docker = F.col("services"), F.col("dockerfiles")
    # fixed values: weights, descriptions and names
    return {
        "Microservices": [(4, "multiple top-level sub-projects with their own manifest", services >= 2), (3, "multiple Dockerfiles at different paths", docker >= 2), (2, "docker-compose defines the deployment topology", f("docker-compose.yml", "docker-compose.yaml"))],
        "Serverless": [(4, "serverless.yml present", f("serverless.yml")), (3, "SAM/CloudFormation template present", f("template.yaml", "template.yml")), (2, "handler-style entrypoint file(s)", f("handler.py", "lambda_function.py", "index.mjs"))],
        "Hexagonal": [(4, "ports/adapters folders present", d("ports", "adapters")), (3, "domain + infrastructure separation", d("domain") & d("infrastructure", "infra"))],
        "Clean Architecture": [(4, "domain/application/infrastructure layering", d("domain") & d("application") & d("infrastructure")), (2, "usecases folder present", d("usecases", "use_cases"))],
        "Event-Driven": [(4, "producer/consumer or queue-oriented folders", d("consumers", "producers", "handlers", "subscribers")), (3, "message broker dependency", F.col("broker"))],
        "Layered": [(3, "controller/service/repository layering", d("controllers", "controller") & d("services", "service")), (2, "repository layer present", d("repositories", "repository", "dao"))],
        "MVC": [(4, "models/views/controllers folders present", d("models", "model") & d("views", "view") & d("controllers", "controller")), (2, "Django-style app module (models.py + views.py + urls.py)", f("models.py") & f("views.py") & f("urls.py"))],
        "Monolith": [(2, "single top-level application, no service split", services <= 1), (1, "no deployment-topology signals found", (docker <= 1) & ~f("docker-compose.yml"))],
    }


def candidates(seen: DataFrame) -> DataFrame:
    """job_id, style, style_seq, confidence, evidence: one row for each of eight styles."""
    rows = []
    for i, (style, signals) in enumerate(_signals().items()):
        most = sum(w for w, _, _ in signals)
        raw = sum((F.when(c, w).otherwise(0) for w, _, c in signals[1:]), F.when(signals[0][2], signals[0][0]).otherwise(0))
        why = F.array_compact(F.array(*[F.when(c, F.lit(t)) for _, t, c in signals]))
        rows.append(F.struct(F.lit(style).alias("style"), F.lit(i).alias("style_seq"), F.bround(raw * 100 / most).cast("int").alias("confidence"), why.alias("evidence")))
    return seen.select("job_id", F.inline(F.array(*rows)))


def detect_architecture(files: DataFrame, imports: DataFrame) -> DataFrame:
    """job_id, primary_style, confidence, evidence, all_candidates.

    Monolith is chosen only when no other style reaches the least confidence."""
    c = candidates(observations(files, imports))
    rank = F.struct((F.col("style") != "Monolith").cast("int"), "confidence", -F.col("style_seq"))
    fit = (F.col("style") == "Monolith") | (F.col("confidence") >= LEAST)
    best = c.where(fit).groupBy("job_id").agg(F.max_by(F.struct("style", "confidence", "evidence"), rank).alias("b"))
    every = c.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "style_seq", "style", "confidence", "evidence"))).alias("a"))
    x = best.join(every, "job_id")
    return x.select("job_id", F.col("b.style").alias("primary_style"), "b.confidence", "b.evidence", F.transform("a", lambda s: F.struct(s["style"].alias("style"), s["confidence"].alias("confidence"), s["evidence"].alias("evidence"))).alias("all_candidates"))


def ranked(c: DataFrame) -> DataFrame:
    return c.withColumn("rank", F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("confidence"), "style_seq")))
