"""Scores from 0 to 100, each with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(c).cast("int")))


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row a job with a count for each severity."""
    return findings.groupBy("job_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES])


def penalised(weights: dict[str, int], prefix: str = "") -> Column:
    """100 less the weighted counts; a severity without a weight costs 3."""
    return F.lit(100.0) - sum((F.coalesce(f"{prefix}{s}", F.lit(0)) * weights.get(s, 3) for s in V.SEVERITIES[1:]), F.coalesce(f"{prefix}{V.SEVERITIES[0]}", F.lit(0)) * weights.get(V.SEVERITIES[0], 3))


def reasons(prefix: str = "") -> Column:
    parts = F.array_compact(F.array(*[F.when(F.col(f"{prefix}{s}") > 0, F.concat(F.col(f"{prefix}{s}").cast("string"), F.lit(f" {s} finding(s)"))) for s in V.SEVERITIES]))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("no findings in this category")))


def _percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100).cast("int").cast("string"), F.lit("%"))


def documentation_facts(parsed: DataFrame) -> DataFrame:
    """job_id, readme, docs, code_lines, comment_lines, test_files, code_files."""
    code = ~F.col("language").isin(*V.NOT_CODE)
    ls = F.filter(F.transform(T.lines("source"), T.strip), lambda l: l != "")
    comment = lambda l: F.exists(F.array(*[F.lit(p) for p in V.COMMENT_PREFIXES]), lambda p: F.startswith(l, p))
    x = parsed.select("job_id", "path", "language", F.when(code, F.size(ls)).otherwise(0).alias("n"), F.when(code, F.size(F.filter(ls, comment))).otherwise(0).alias("c"))
    return x.groupBy("job_id").agg(F.bool_or(F.lower("path").isin("readme.md", "readme.rst", "readme.txt")).alias("readme"), F.count_if(F.col("language") == "markdown").alias("docs"), F.sum("n").alias("code_lines"), F.sum("c").alias("comment_lines"), F.count_if(T.is_test("path")).alias("test_files"), F.count_if(code).alias("code_files"))


def compute_scores(parsed: DataFrame, architecture: DataFrame, quality: DataFrame, metrics: DataFrame, security: DataFrame, performance: DataFrame, violations: DataFrame) -> DataFrame:
    """job_id, name, score, reasoning: nine rows a job."""
    pre = lambda df, p: df.select("job_id", *[F.col(s).alias(f"{p}{s}") for s in V.SEVERITIES])
    readable = quality.where(F.col("category").isin("magic_number", "deep_nesting", "long_method"))
    perf = performance.groupBy("job_id").agg(*[F.bool_or(F.col("category") == c).alias(c) for c in ("n_plus_one_query", "expensive_loop", "blocking_call")], F.count("*").alias("perf_n"))
    solid = violations.groupBy("job_id").agg(F.count("*").alias("violations"), F.count_if(F.col("principle") == "DIP").alias("dip"))
    x = documentation_facts(parsed).join(architecture, "job_id", "left").join(metrics, "job_id", "left").join(perf, "job_id", "left").join(solid, "job_id", "left")
    for p, df in (("q_", quality), ("s_", security), ("p_", performance), ("r_", readable)):
        x = x.join(pre(severity_counts(df), p), "job_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    with_if = lambda base, *more: F.concat(base, F.array_compact(F.array(*more)))
    average = F.coalesce("average_complexity", F.lit(0.0))
    ratio = F.when(F.col("code_files") > 0, F.col("test_files") / F.col("code_files")).otherwise(F.lit(0.0))
    comments = F.when(F.col("code_lines") > 0, F.col("comment_lines") / F.col("code_lines")).otherwise(F.lit(0.0))
    maintain, read = clamp(penalised(V.MAINTAIN_PENALTY, "q_")), clamp(penalised(V.READ_PENALTY, "r_"))
    test = clamp(ratio * 200)
    style = F.col("primary_style")
    scale = F.when(style.isin(*V.SCALABLE), 70).otherwise(55) - F.when(yes("n_plus_one_query"), 15).otherwise(0) - F.when(yes("expensive_loop"), 10).otherwise(0) - F.when(yes("blocking_call"), 10).otherwise(0)
    none = F.array().cast("array<string>")
    x = x.select(
        "job_id",
        F.col("confidence").alias("architecture"), clamp(penalised(V.PENALTY, "s_")).alias("security"), clamp(penalised(V.PERFORMANCE_PENALTY, "p_")).alias("performance"),
        clamp((maintain - n("violations") * 3).cast("double")).alias("maintainability"), F.when(average > 8, clamp((read - 10).cast("double"))).otherwise(read).alias("readability"), clamp(scale.cast("double")).alias("scalability"),
        F.when(n("dip") > 0, clamp((test - n("dip") * 4).cast("double"))).otherwise(test).alias("testability"),
        clamp((F.when(F.col("readme"), 40).otherwise(10) + F.least(F.lit(30), F.col("docs") * 5) + F.least(F.lit(30), F.bround(comments * 150).cast("int"))).cast("double")).alias("documentation"),
        F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(F.array(F.concat(F.lit("classified as "), style, F.lit(" by default")))).alias("w_architecture"), reasons("s_").alias("w_security"), reasons("p_").alias("w_performance"),
        with_if(reasons("q_"), F.when(n("violations") > 0, F.concat(n("violations").cast("string"), F.lit(" SOLID violation(s)")))).alias("w_maintainability"),
        with_if(reasons("r_"), F.when(average > 8, F.concat(F.lit("average cyclomatic complexity "), average.cast("string"), F.lit(" is high")))).alias("w_readability"),
        with_if(F.array(F.concat(F.lit("baseline for "), style, F.lit(" architecture"))), F.when(yes("n_plus_one_query"), F.lit("N+1 query patterns limit horizontal scalability")), F.when(yes("expensive_loop"), F.lit("nested loops found — may not scale with input size")), F.when(yes("blocking_call"), F.lit("blocking calls found in async code paths")), F.when(n("perf_n") == 0, F.lit("no scalability-limiting performance findings"))).alias("w_scalability"),
        with_if(F.array(F.concat(F.col("test_files").cast("string"), F.lit(" test file(s) out of "), F.col("code_files").cast("string"), F.lit(" code file(s) ("), _percent(ratio), F.lit(" ratio)"))), F.when(n("dip") > 0, F.concat(n("dip").cast("string"), F.lit(" DIP violation(s) (direct construction of dependencies) make unit testing harder")))).alias("w_testability"),
        F.array(F.when(F.col("readme"), "README present").otherwise("no README found"), F.concat(F.col("docs").cast("string"), F.lit(" markdown doc file(s)")), F.concat(_percent(comments), F.lit(" of non-blank code lines are comments"))).alias("w_documentation"),
    )
    names = list(V.SCORE_WEIGHTS)
    total = F.lit(0.0)
    for k in names:  # in this order: sums of doubles depend on it
        total = total + F.col(k) * F.lit(V.SCORE_WEIGHTS[k])
    rows = [F.struct(F.lit(k).alias("name"), F.col(k).cast("int").alias("score"), F.coalesce(f"w_{k}", none).alias("reasoning")) for k in names]
    rows.append(F.struct(F.lit("overall").alias("name"), clamp(total).alias("score"), F.array(F.lit(f"weighted average of the 8 category scores (weights: {V.SCORE_WEIGHTS})")).alias("reasoning")))
    return x.select("job_id", F.inline(F.array(*rows)))


def bands(scores: DataFrame) -> DataFrame:
    """Category scores, without the overall one, with a band each."""
    return scores.where("name <> 'overall'").select("job_id", F.col("name").alias("category"), "score", F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor").alias("band"))
