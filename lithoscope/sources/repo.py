"""Repositories as tables: a directory, a ZIP archive or a git URL.

Of a directory the driver lists names only and prunes ignored directories before
descending; the executors, which must see it too, read the contents and leave out binary
ones.  Archives are read by the executors (archive.py); a clone, which is the driver's
own, is packed into one by git."""

from __future__ import annotations

import os
import shutil
import subprocess
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError
from ..functions import text as T
from ..functions import values as V

RAW = "job_id string, file_seq long, path string, abs_path string, size_bytes long, content binary"


def open_repo(source: str, workspace: str | None = None) -> Path:
    """A directory for a local path, a .zip file or a git URL."""
    if "://" in source or source.startswith("git@"):
        return clone_git(source, Path(workspace or "."))
    if source.lower().endswith(".zip"):
        return extract_zip(Path(source), Path(workspace or "."))
    return local_dir(source)


def local_dir(source: str) -> Path:
    path = Path(source).expanduser().resolve()
    if not path.exists():
        raise IngestError(f"no such path: {path}")
    if not path.is_dir():
        raise IngestError(f"not a directory: {path}")
    return path


def clone_git(url: str, workspace: Path) -> Path:
    """One branch, one commit deep."""
    to = workspace / "repo"
    try:
        subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--single-branch", "--", url, str(to)], check=True, capture_output=True, text=True)
    except (OSError, subprocess.CalledProcessError) as e:
        raise IngestError(f"can't clone {url}: {getattr(e, 'stderr', '') or e}") from e
    return to


def extract_zip(archive: Path, workspace: Path) -> Path:
    """Unpacks below workspace/repo.  A member that would leave it is an error; a
    single directory that wraps everything is taken away."""
    to = (workspace / "repo").resolve()
    to.mkdir(parents=True, exist_ok=True)
    try:
        with zipfile.ZipFile(archive) as z:
            for m in z.infolist():
                if not (to / m.filename).resolve().is_relative_to(to):
                    raise IngestError(f"unsafe path in archive: {m.filename}")
            z.extractall(to)
    except zipfile.BadZipFile as e:
        raise IngestError(f"not a ZIP archive: {archive}") from e
    inside = list(to.iterdir())
    if len(inside) == 1 and inside[0].is_dir():
        wrapped = inside[0].rename(to.parent / f".{to.name}-wrapped")
        to.rmdir()
        wrapped.rename(to)
    return to


def remove(workspace: str | Path) -> None:
    shutil.rmtree(workspace, ignore_errors=True)


def list_files(root: Path, max_files: int | None = None, max_bytes: int = V.MAX_FILE_BYTES) -> list[tuple[str, str, int]]:
    """(path, absolute path, bytes) in order of path; ignored, empty and too large files
    left out.  No file is opened."""
    ignored, tails = set(V.IGNORED_DIRS), V.IGNORED_SUFFIXES
    found = []
    for d, names, files in os.walk(root):
        names[:] = [n for n in names if n not in ignored]
        for n in files:
            if n in V.IGNORED_NAMES or n.lower().endswith(tails):
                continue
            at = os.path.join(d, n)
            try:
                size = os.stat(at).st_size
            except OSError:
                continue
            if 0 < size <= max_bytes:
                found.append((os.path.relpath(at, root).replace(os.sep, "/"), at, size))
    return sorted(found)[:max_files]


def pack_clone(clone: Path, to: Path) -> Path:
    """The files of a clone as one archive."""
    try:
        subprocess.run(["git", "-C", str(clone), "archive", "--format=zip", "-o", str(to), "HEAD"], check=True, capture_output=True, text=True)
    except (OSError, subprocess.CalledProcessError) as e:
        raise IngestError(f"can't pack {clone}: {getattr(e, 'stderr', '') or e}") from e
    return to


def stage(spark: SparkSession, archive: Path, to: str) -> None:
    """Copies one archive of the driver's to a folder that the executors read."""
    if not archive.is_file():
        raise IngestError(f"no such archive: {archive}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(to)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    fs.copyFromLocalFile(False, True, hadoop.Path(f"file://{archive.absolute()}"), path)


def unstage(spark: SparkSession, folder: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_files(spark: SparkSession, root: Path, job_id: str, max_files: int = V.MAX_FILES, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """RAW rows of a directory that driver and executors share.  The first `max_files`
    text files count."""
    rows = [(job_id, i, p, a, n) for i, (p, a, n) in enumerate(list_files(root, max_bytes=max_bytes))]
    names = spark.createDataFrame(rows, "job_id string, file_seq long, path string, abs_path string, size_bytes long")

    def read(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([Path(p).read_bytes() for p in part.column("abs_path").to_pylist()], pa.binary())], names=[*part.schema.names, "content"])

    raw = names.repartition(max(1, min(len(rows) // 200 + 1, 200))).mapInArrow(read, RAW)
    return raw if len(rows) <= max_files else raw.where(T.is_text(F.col("content"))).orderBy("file_seq").limit(max_files)


def files(raw: DataFrame) -> DataFrame:
    """job_id, file_seq, path, language, size_bytes, loc, source of RAW rows."""
    x = raw.where(T.is_text(F.col("content")) & (F.col("size_bytes") > 0))
    x = x.select("job_id", "file_seq", "path", T.language("path").alias("language"), "size_bytes", T.decode(F.col("content")).alias("source"))
    return x.withColumn("loc", F.size(T.lines("source")))


def from_texts(df: DataFrame, job_id: str, path: str, source: str) -> DataFrame:
    """The same of any table that has paths and texts: names of columns, or columns."""
    x = df.select(F.col(job_id).cast("string").alias("job_id"), F.col(path).alias("path"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    x = x.where(T.is_kept_path("path"))
    return x.select("job_id", F.xxhash64("path").alias("file_seq"), "path", T.language("path").alias("language"), F.octet_length("source").cast("long").alias("size_bytes"), "source", F.size(T.lines("source")).alias("loc"))
