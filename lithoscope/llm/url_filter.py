"""URL filter: allow and block rules by host and path, then a weighted
vocabulary found with one Aho-Corasick automaton.

A term has a weight: one of `STRICT` or more rejects alone, lighter ones reject when
several distinct ones hit.  A hit counts only between characters that are not letters or
digits.  The vocabulary is data (`url_terms.csv` beside this module, or any terms given);
the driver reads it and sends it along.

Defined cases: a null url, or one without `://`, has an empty host and path, fits
no rule and is judged by the vocabulary on the whole url; a very long url is read whole;
a page id may be null or of any type and is passed through; repeated rows repeat; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: (verdict, rule): a rule is a host, then a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
STRICT = 2
LEAST_SOFT = 2


def read_terms(path: str | None = None) -> list[tuple[str, int]]:
    """(term, weight) rows of a CSV file with these two columns."""
    with open(path or os.path.join(os.path.dirname(__file__), "url_terms.csv"), newline="", encoding="utf-8") as f:
        return [(r["term"].translate(_AZ), int(r["weight"])) for r in csv.DictReader(f)]


_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def parts(url: str | None) -> tuple[str, str]:
    m = _URL.search(url or "")
    return (m[1].translate(_AZ), m[2]) if m else ("", "")


class Rules:
    """Longest rule first by walking the host's suffixes: no scan of all rules."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def of(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, verdict, h = None, None, host
        while h:
            for p, rule, v in self.by_host.get(h, ()):
                if path.startswith(p) and (best is None or len(rule) > len(best)):
                    best, verdict = rule, v
            h = h.partition(".")[2]
        return best, verdict


def automaton(terms: Sequence[tuple[str, int]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t, weight in terms:
        a.add_word(t, (t, int(weight >= STRICT)))
    a.make_automaton()
    return a


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(a: ahocorasick.Automaton, url: str) -> tuple[int, int]:
    """Distinct strict and soft terms between boundaries."""
    s = url.translate(_AZ)
    seen: tuple[set, set] = (set(), set())
    for end, (t, w) in a.iter(s):
        i = end - len(t) + 1
        if not (i and _word(s[i - 1])) and not (end + 1 < len(s) and _word(s[end + 1])):
            seen[w].add(t)
    return len(seen[1]), len(seen[0])


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, terms: Sequence[tuple[str, int]] | None = None, least_soft: int = LEAST_SOFT) -> DataFrame:
    """One row per row of pages: id_col, url_col, host, path, rule, verdict,
    n_strict, n_soft.  Only the two columns are read, and nothing is shuffled."""
    C.ship(pages.sparkSession)
    terms = read_terms() if terms is None else list(terms)

    def run(batches):
        known, a = Rules(rules), automaton(terms)
        for b in C.slices(batches):
            rows = []
            for u in b.column(1).to_pylist():
                host, path = parts(u)
                rule, verdict = known.of(host, path)
                n, m = hits(a, u or "")
                rows.append((host, path, rule, verdict or ("block" if n or m >= least_soft else "allow"), n, m))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            made = [pa.array(list(c), t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int64()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), *made], names=["id", "url", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    kind = dict(pages.dtypes)[id_col]
    x = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    out = x.mapInArrow(run, f"id {kind}, url string, host string, path string, rule string, verdict string, n_strict long, n_soft long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", "verdict", "n_strict", "n_soft")


def rules_sql(table: str = "pages") -> str:
    """The same in SQL, with the vocabulary as patterns."""
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    n, m = (" + ".join(f"CAST({hit(t)} AS BIGINT)" for t, w in read_terms() if (w >= STRICT) == strict) for strict in (True, False))
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    fits = [(len(r), r, v, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in RULES]
    case = lambda f: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{f(r, v)}'" for _, r, v, h, p in sorted(fits, reverse=True)) + " END"
    return f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), {az}) AS u,
  translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), {az}) AS host,
  coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM {table}),
b AS (SELECT page_id, host, path, {case(lambda r, v: r)} AS rule, {case(lambda r, v: v)} AS ruled,
  {n} AS n_strict, {m} AS n_soft FROM a)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN n_strict > 0 OR n_soft >= {LEAST_SOFT} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft FROM b"""
