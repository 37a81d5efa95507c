"""Results as tables, partitioned by job, and the jobs' own table."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound, NotReady

JOBS = "job_id string, name string, source_type string, source_ref string, status string, stage string, progress int, message string, created_at timestamp, seq long"
STAGES = (("ingest", 5), ("parse", 25), ("graph", 55), ("analyze", 70), ("diagram", 85), ("report", 92), ("embed", 96), ("done", 100))
SOURCE_TYPES = ("url", "zip", "local")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; where that is unset, on one
    machine a temporary one, and on a cluster an error: executors would not see it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="lithoscope")
        spark.conf.set("spark.checkpoint.dir", d)
    return f"{d.rstrip('/')}/{spark.sparkContext.applicationId}"


class Store:
    """A folder of Parquet tables, with a partition for each job.  Writing a job's table
    again replaces that partition; of a job's status rows the latest counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _at(self, table: str, job_id: str | None = None):
        """(file system, path) of a table or of a job's part of it."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(table) + (f"/job_id={job_id}" if job_id else ""))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, table: str, job_id: str | None = None) -> bool:
        fs, p = self._at(table, job_id)
        return fs.exists(p)

    def write(self, table: str, df: DataFrame, job_id: str) -> None:
        """Each job's part is a folder of its own, so that jobs can write at the same time."""
        df.drop("job_id").write.mode("overwrite").parquet(f"{self.path(table)}/job_id={job_id}")

    def read(self, table: str, job_id: str) -> DataFrame:
        """Lists and reads one job's part only; no rows where it has none."""
        if not self.exists(table, job_id):
            return self.spark.createDataFrame([], "job_id string")
        return self.spark.read.parquet(f"{self.path(table)}/job_id={job_id}").withColumn("job_id", F.lit(job_id))

    def drop(self, table: str, job_id: str) -> None:
        fs, p = self._at(table, job_id)
        fs.delete(p, True)

    def forget(self, job_id: str, tables) -> None:
        """Drops a job's rows from all tables but the jobs' own."""
        for t in tables:
            self.drop(t, job_id)

    # -- jobs

    def log(self, job_id: str, name: str, source_type: str, ref: str, status: str, stage: str, message: str = "") -> None:
        now = dt.datetime.now(dt.timezone.utc)
        row = (job_id, name, source_type, ref, status, stage, dict(STAGES).get(stage, 0), message[:2000], now, int(now.timestamp() * 1e6))
        self.spark.createDataFrame([row], JOBS).coalesce(1).write.mode("append").parquet(f"{self.path('jobs')}/of={job_id}")

    def jobs(self) -> DataFrame:
        """The latest row of each job."""
        if not self.exists("jobs"):
            return self.spark.createDataFrame([], JOBS)
        cols = [c.split()[0] for c in JOBS.split(", ")]
        latest = self.spark.read.schema(JOBS).parquet(self.path("jobs")).groupBy("job_id").agg(F.max_by(F.struct(*cols), "seq").alias("r"), F.min("created_at").alias("first"))
        return latest.select(*[F.col(f"r.{c}").alias(c) for c in cols if c != "created_at"], F.col("first").alias("created_at"))

    def recent(self, limit: int = 100) -> DataFrame:
        return self.jobs().orderBy(F.desc("created_at"), "job_id").limit(limit)

    def job(self, job_id: str):
        row = self.jobs().where(F.col("job_id") == job_id).first()
        if row is None:
            raise NotFound(f"no job {job_id}")
        return row

    def done_job(self, job_id: str):
        row = self.job(job_id)
        if row.status != "done":
            raise NotReady(f"job {job_id} is {row.status}")
        return row
