"""Frameworks and package managers from manifests.

Of several manifests with one name in a job, the last by order of files counts."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.udf import pandas_function

_NAMES = ("package.json", "requirements.txt", "pyproject.toml", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "go.mod", "Gemfile", "gemfile")
_FIRST = r"[=<>~\[; ]"


def manifests(sources: DataFrame) -> DataFrame:
    """job_id, name, content: the last file of each manifest name."""
    x = sources.withColumn("name", T.basename("path")).where(F.col("name").isin(*_NAMES) | (F.lower("name").isin("cargo.toml", "gemfile")))
    return x.groupBy("job_id", "name").agg(F.max_by("source", F.struct("file_seq", "path")).alias("content"))


def json_keys(content: Column, *fields: str) -> Column:
    """The keys of some objects in a JSON document; what is no object has none."""
    parts = [F.coalesce(F.json_object_keys(F.get_json_object(content, f"$['{f}']")), F.array().cast("array<string>")) for f in fields]
    return F.array_distinct(F.concat(*parts))


def requirement_names(content: Column) -> Column:
    return F.transform(F.filter(F.transform(T.lines(F.lower(content)), T.strip), lambda l: l != ""), lambda l: F.element_at(F.split(l, _FIRST), 1))


@pandas_function("array<string>")
def toml_names(content: pd.Series) -> pd.Series:
    """Dependencies of [project] and [tool.poetry]: Spark has no TOML reader."""

    def names(s):
        try:
            data = tomllib.loads(s or "")
        except tomllib.TOMLDecodeError:
            return []
        deps = data.get("project", {}).get("dependencies", []) if isinstance(data.get("project", {}), dict) else []
        import re

        found = [re.split(_FIRST, d.strip())[0].lower() for d in deps if isinstance(d, str)]
        tool = data.get("tool", {})
        poetry = tool.get("poetry", {}) if isinstance(tool, dict) else {}
        more = poetry.get("dependencies", {}) if isinstance(poetry, dict) else {}
        return found + [k.lower() for k in more]

    return content.map(names)


def detect_ecosystem(sources: DataFrame) -> DataFrame:
    """job_id, frameworks, package_managers (both sorted); jobs without any are absent."""
    m = manifests(sources)
    known = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (v, k)])
    node = F.transform(F.array_intersect(json_keys(F.col("content"), "dependencies", "devDependencies"), F.array(*[F.lit(p) for p in V.NODE_FRAMEWORKS.values()])), lambda p: F.element_at(known(V.NODE_FRAMEWORKS), p))
    python = lambda names: F.array_intersect(names, F.array(*[F.lit(p) for p in V.PYTHON_FRAMEWORKS]))
    php_keys = json_keys(F.col("content"), "require", "require-dev")
    php = F.array_compact(F.array(F.when(F.exists(php_keys, lambda k: k.contains("laravel/framework")), "laravel"), F.when(F.exists(php_keys, lambda k: k.startswith("symfony/")), "symfony")))
    holds = lambda s, name: F.array_compact(F.array(F.when(F.lower("content").contains(s), name)))
    name, low = F.col("name"), F.lower("name")
    none = F.array().cast("array<string>")
    toml = m.where("name = 'pyproject.toml'").select("job_id", python(toml_names("content")).alias("f"), F.lit("poetry/pip").alias("p"))
    rest = m.where("name <> 'pyproject.toml'").select(
        "job_id",
        F.when(name == "package.json", node).when(name == "requirements.txt", python(requirement_names(F.col("content")))).when(name.isin("pom.xml", "build.gradle", "build.gradle.kts"), holds("spring-boot", "spring boot"))
        .when(name == "composer.json", php).when(name.isin("Gemfile", "gemfile"), holds("rails", "rails")).otherwise(none).alias("f"),
        F.when(name == "package.json", "npm/yarn/pnpm").when(name == "requirements.txt", "pip").when(name == "pom.xml", "maven").when(name.startswith("build.gradle"), "gradle").when(name == "composer.json", "composer")
        .when(name == "go.mod", "go modules").when(low == "cargo.toml", "cargo").when(low == "gemfile", "bundler").alias("p"),
    )
    x = toml.unionByName(rest)
    return x.groupBy("job_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("frameworks"), F.array_sort(F.collect_set("p")).alias("package_managers"))
