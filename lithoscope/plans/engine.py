"""The engine: one call analyses a repository and stores every result table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udf import ship
from ..operators import api_surface, architecture, database, design, diagrams, ecosystem, findings, graph, parsing, report, retrieval, scoring, semantic, summary
from ..sources import archive, repo
from ..sources.store import Store


@dataclass
class Settings:
    store: str = "lithoscope-store"
    max_files: int = 8000
    max_file_bytes: int = 1_000_000
    top_k: int = 6
    workers: int = 2  # jobs at a time of those submitted
    semantic: bool = False  # vectors of each job's own latent semantic space

#: Tables that hold a job's results.
TABLES = (
    "parsed", "files", "symbols", "imports", "nodes", "edges", "tables", "relationships", "endpoints", "architecture", "findings", "metrics", "violations", "patterns",
    "summary", "folders", "api_surface", "scores", "diagram_nodes", "diagram_edges", "chunks", "reports", "words", "vectors",
)


def analyze(parsed: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df, embedder: retrieval.Embedder | None = None) -> dict[str, DataFrame]:
    """Every result table of any number of parsed repositories.

    keep(name, df) may write a table and return it as read again: what later tables
    build on goes through it first, so that no join is computed twice."""
    code = parsing.Code(parsed)
    files, sources, imports, symbols = code.files, code.sources, code.imports, code.symbols
    out: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        out[name] = keep(name, df)
        return out[name]

    eco = ecosystem.detect_ecosystem(sources)
    for name, df in (("files", files), ("symbols", symbols), ("imports", imports)):
        put(name, df)
    nodes, edges = put("nodes", graph.nodes(code)), put("edges", graph.edges(code))
    tables = put("tables", database.detect_tables(code))
    relations = put("relationships", database.relationships(tables))
    endpoints = put("endpoints", api_surface.endpoints(sources))
    style = put("architecture", architecture.detect_architecture(files, imports))
    found = put("findings", reduce(DataFrame.unionByName, [findings.by_severity(f) for f in (findings.analyze_quality(code, edges.where("type = 'calls'")), findings.analyze_security(code.lines), findings.analyze_performance(code))]))
    quality, security, performance = (found.where(F.col("analyzer") == a) for a in ("quality", "security", "performance"))
    metrics, violations = put("metrics", findings.quality_metrics(code.functions)), put("violations", design.analyze_solid(code))
    put("patterns", design.detect_patterns(code))
    put("summary", summary.summary(files, eco))
    tree = put("folders", summary.tree_rows(files))
    put("api_surface", api_surface.detect_api_surface(sources, symbols, imports))
    put("scores", scoring.compute_scores(parsed, style, quality, metrics, security, performance, violations))
    jobs = files.select("job_id").distinct()
    parts = [
        diagrams.folder_tree(tree), diagrams.module_dependency(nodes, edges), diagrams.package_dependency(nodes, edges), diagrams.call_graph(nodes, edges), diagrams.class_diagram(nodes, edges),
        diagrams.component_diagram(files, edges, 1), diagrams.component_diagram(files, edges, 2), diagrams.er_diagram(tables, relations), diagrams.api_flow(jobs, endpoints),
        diagrams.deployment(jobs, sources, tables, endpoints), diagrams.sequence(endpoints, code.functions, nodes, edges), diagrams.data_flow(files, tables),
    ]
    dn, de = diagrams.cap(reduce(DataFrame.unionByName, [p[0] for p in parts]), reduce(DataFrame.unionByName, [p[1] for p in parts]))
    put("diagram_nodes", dn)
    put("diagram_edges", de)
    put("chunks", retrieval.index(retrieval.chunk_repository(code), embedder))
    return out


@dataclass
class Engine:
    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    model: report.LanguageModel | None = None
    embedder: retrieval.Embedder = field(default_factory=retrieval.HashingEmbedder)

    def __post_init__(self):
        ship(self.spark)
        self.store = Store(self.spark, self.settings.store)
        self._pool = ThreadPoolExecutor(self.settings.workers, "analysis")
        self._pending: dict[str, Future] = {}

    def analyze(self, source: str, name: str | None = None) -> str:
        """Analyses a directory, ZIP archive or git URL; returns the job's id.  A failure
        is kept in the job's row, and raised."""
        job = uuid.uuid4().hex
        self._run(job, source, name)
        return job

    def submit(self, source: str, name: str | None = None) -> str:
        """As analyze(), in the background: returns the job's id at once.  Its row tells
        how far it is, or why it failed; wait() waits for it."""
        job = uuid.uuid4().hex
        self._log(job, source, name, "pending", "ingest")
        self._pending[job] = self._pool.submit(self._run, job, source, name)
        return job

    def wait(self, job: str, seconds: float | None = None):
        """The row of a job, once it has ended; its failure is in the row."""
        if job in self._pending:
            self._pending[job].exception(seconds)
            del self._pending[job]
        return self.store.job(job)

    def delete(self, job: str) -> None:
        """Drops a job's results, its vectors among them; its row stays."""
        self.store.job(job)
        self.store.forget(job, TABLES)

    @staticmethod
    def _kind(source: str) -> str:
        return "url" if "://" in source or source.startswith("git@") else "zip" if source.lower().endswith(".zip") else "local"

    def _log(self, job: str, source: str, name: str | None, status: str, stage: str, message: str = "") -> None:
        self.store.log(job, self._name(source, name), self._kind(source), source, status, stage, message)

    @staticmethod
    def _name(source: str, name: str | None) -> str:
        return name or Path(source.rstrip("/")).name.removesuffix(".git").removesuffix(".zip")

    def _run(self, job: str, source: str, name: str | None) -> None:
        log = lambda status, stage, message="": self._log(job, source, name, status, stage, message)
        self.spark.sparkContext.setJobGroup(job, f"analysis of {source}", True)
        log("running", "ingest")
        workspace, staging = tempfile.mkdtemp(prefix="lithoscope"), None
        try:
            limits = {"max_files": self.settings.max_files, "max_bytes": self.settings.max_file_bytes}
            if self._kind(source) == "local":
                raw = repo.read_files(self.spark, repo.local_dir(source), job, **limits)
            else:  # the driver's own: one archive, which the executors unpack
                packed = Path(source) if self._kind(source) == "zip" else repo.pack_clone(repo.clone_git(source, Path(workspace)), Path(workspace) / "clone.zip")
                staging = self.store.path(f"staging/{job}")
                repo.stage(self.spark, packed, f"{staging}/{job}.zip")
                raw = archive.read_archives(self.spark, staging, job, **limits).repartition("path")
            log("running", "parse")
            self.store.write("parsed", parsing.parse_files(repo.files(raw)), job)
            parsed = self.store.read("parsed", job)
            log("running", "analyze")

            def keep(table: str, df: DataFrame) -> DataFrame:
                self.store.write(table, df, job)
                return self.store.read(table, job)

            chunks = analyze(parsed, keep, self.embedder)["chunks"]
            if self.settings.semantic:
                log("running", "embed")
                words, vectors = semantic.fit_embed(chunks)
                keep("words", words)
                keep("vectors", vectors)
            log("running", "report")
            text = report.synthesize(self._name(source, name), self._facts(job), self.model)
            self.store.write("reports", self.spark.createDataFrame([(job, text)], "job_id string, report_markdown string"), job)
            log("done", "done")
        except Exception as e:
            log("failed", "done", str(e))
            raise
        finally:
            repo.remove(workspace)
            if staging:
                repo.unstage(self.spark, staging)

    def _rows(self, table: str, job: str) -> list[dict]:
        """A result table of one job, small by the caps on files and diagrams."""
        return [r.asDict(recursive=True) for r in self.store.read(table, job).drop("job_id").collect()]

    def _facts(self, job: str) -> dict:
        count = lambda t, c: {r[0]: r[1] for r in self.store.read(t, job).groupBy(c).count().orderBy(c).collect()}
        one = lambda t: (self._rows(t, job) or [{}])[0]
        found = self.store.read("findings", job)
        of = lambda a: {r[0]: r[1] for r in found.where(F.col("analyzer") == a).groupBy("category").count().orderBy("category").collect()}
        empty = {"total_files": 0, "total_loc": 0, "languages": {}, "primary_language": None, "frameworks": [], "package_managers": []}
        return {
            "summary": one("summary") or empty, "architecture": one("architecture") or {"primary_style": "Monolith", "confidence": 0, "evidence": []}, "tables": self._rows("tables", job), "api": one("api_surface") or {"protocols": [], "endpoint_count": 0, "mechanisms": []},
            "patterns": count("patterns", "pattern"), "solid": count("violations", "principle"), "security": of("security"), "performance": of("performance"), "metrics": one("metrics"), "scores": self._rows("scores", job),
        }

    # -- reading

    def result(self, job: str) -> dict:
        self.store.done_job(job)
        f = self._facts(job)
        found = self._rows("findings", job)
        of = lambda a: sorted((x for x in found if x["analyzer"] == a), key=lambda x: x["position"])
        tree = summary.nest([r.asDict() for r in self.store.read("folders", job).collect()])
        relations = self._rows("relationships", job)
        return {
            "summary": f["summary"], "architecture": f["architecture"], "folders": tree, "dependency_graph": {"nodes": self._rows("nodes", job), "edges": self._rows("edges", job)},
            "database_schema": {"orms_detected": sorted({t["orm"] for t in f["tables"]}), "tables": f["tables"], "relationships": relations}, "api_surface": f["api"] | {"endpoints": self._rows("endpoints", job)},
            "patterns": {"summary": f["patterns"], "matches": self._rows("patterns", job)}, "solid": {"summary": f["solid"], "violations": self._rows("violations", job)}, "quality": {"metrics": f["metrics"], "findings": of("quality")},
            "security": {"summary": f["security"], "findings": of("security")}, "performance": {"summary": f["performance"], "findings": of("performance")}, "scores": {x["name"]: x for x in f["scores"]},
            "diagrams": {t: self.diagram(job, t) for t in self.list_diagrams(job)}, "report_markdown": self.report(job),
        }

    def list_diagrams(self, job: str) -> list[str]:
        self.store.done_job(job)
        return sorted(diagrams.TYPES)

    def diagram(self, job: str, kind: str) -> dict:
        from ..errors import NotReady

        self.store.done_job(job)
        if kind not in diagrams.TYPES:
            raise NotReady(f"no diagram {kind}")
        at = lambda t: [r.asDict(recursive=True) for r in self.store.read(t, job).where(F.col("diagram") == kind).orderBy("position").drop("job_id", "diagram", "position").collect()]
        nodes = at("diagram_nodes")
        return {"type": kind, "nodes": [{"id": n["id"], "type": n["type"], "data": {"label": n["label"], **n["data"]}} for n in nodes], "edges": at("diagram_edges"), "truncated": any(n["truncated"] for n in nodes)}

    def report(self, job: str) -> str:
        self.store.done_job(job)
        return self.store.read("reports", job).first().report_markdown

    def export(self, job: str, kind: str) -> tuple[bytes, str, str]:
        row = self.store.done_job(job)
        return report.export(row.name, self.result(job), kind)

    def source(self, job: str, file: str) -> DataFrame:
        self.store.done_job(job)
        return retrieval.source_chunks(self.store.read("chunks", job), file)

    def ask(self, job: str, question: str, history: list[dict] | None = None) -> tuple[str, list[dict]]:
        """(answer, sources): a model's answer about the nearest chunks, or the chunks."""
        row = self.store.done_job(job)
        chunks = self.store.read("chunks", job)
        if self.settings.semantic:
            chunks = chunks.drop("embedding").join(self.store.read("vectors", job).drop("job_id"), "chunk_id").where("embedding IS NOT NULL")
            asked = self.spark.createDataFrame([("question", question)], "chunk_id string, text string")
            q = semantic.embed(asked, self.store.read("words", job)).first().embedding
        else:
            q = self.embedder.embed([question])[0].tolist()
        hits = [r.asDict() for r in retrieval.nearest(chunks, q, self.settings.top_k).collect()] if q else []
        sources = [{k: h[k] for k in ("file", "start_line", "end_line", "symbol")} for h in hits]
        if self.model is None or not self.model.is_available:
            return retrieval.fallback_answer(hits), sources
        context = "\n\n".join(f"### {h['file']} [lines {h['start_line']}-{h['end_line']}]\n```\n{h['text']}\n```" for h in hits)
        return self.model.chat(f"Answer questions about the code of {row.name} from the excerpts only; cite files and lines.", [*(history or []), {"role": "user", "content": f"{context}\n\nQuestion: {question}"}], 1200), sources
