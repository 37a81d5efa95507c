"""Repositories in ZIP archives, unpacked by the executors.

An archive is a row with its bytes, as Spark's binaryFile source reads it from any file
system: many archives are many rows.  A task reads the archive's directory first, decides
by names and sizes what is kept, and unpacks only that.  No file passes the driver, and
none is written before it is a row.

Kept is what a directory of the same files would give: neither ignored, empty nor too
large; a single directory that wraps everything is taken away; of text files the first
`max_files` in order of path.  A member whose path leaves the archive, or an archive that
can't be read, is an error.  A member is never unpacked beyond `max_bytes`, whatever
size the directory tells."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError
from ..functions import values as V
from .repo import RAW

_SCHEMA = pa.schema([("job_id", pa.string()), ("file_seq", pa.int64()), ("path", pa.string()), ("abs_path", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary())])


def _kept(path: str) -> bool:
    *folders, name = path.split("/")
    return not set(folders) & set(V.IGNORED_DIRS) and name not in V.IGNORED_NAMES and not name.lower().endswith(V.IGNORED_SUFFIXES)


def members(archive: zipfile.ZipFile, max_bytes: int) -> list[tuple[str, zipfile.ZipInfo]]:
    """(path, member) of what is kept, in order of path, by the archive's directory alone."""
    found = {}
    for m in archive.infolist():
        path = posixpath.normpath(m.filename.replace("\\", "/"))
        if path.startswith(("/", "../")) or path == ".." or m.filename.startswith("/"):
            raise IngestError(f"unsafe path in archive: {m.filename}")
        if not m.is_dir():
            found[path] = m  # of members of one name the last counts, as when unpacked
    tops = {p.split("/")[0] for p in found}
    if len(tops) == 1 and all("/" in p for p in found):
        found = {p.split("/", 1)[1]: m for p, m in found.items()}
    return sorted((p, m) for p, m in found.items() if _kept(p) and 0 < m.file_size <= max_bytes)


def _contents(job: str, name: str, content: bytes, max_files: int, max_bytes: int):
    """A row for each text file that counts."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            number = 0
            for seq, (path, m) in enumerate(members(z, max_bytes)):
                if number == max_files:
                    return
                with z.open(m) as f:
                    data = f.read(max_bytes + 1)
                if len(data) > max_bytes or b"\0" in data[: V.SNIFF_BYTES]:
                    continue
                number += 1
                yield job, seq, path, f"{name}!/{m.filename}", len(data), data
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
        raise IngestError(f"not a ZIP archive that can be read: {name}: {e}") from e


def unpack(archives: DataFrame, max_files: int = V.MAX_FILES, max_bytes: int = V.MAX_FILE_BYTES, batch_bytes: int = 4 << 20) -> DataFrame:
    """RAW rows of archives (job_id, name, content), a few megabytes at a time."""

    def run(batches):
        for b in batches:
            for job, name, content in zip(*[b.column(c).to_pylist() for c in ("job_id", "name", "content")], strict=True):
                rows, size = [], 0
                for r in _contents(job, name, content or b"", max_files, max_bytes):
                    rows.append(r)
                    size += r[4]
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return archives.select("job_id", "name", "content").mapInArrow(run, RAW)


def read_archives(spark: SparkSession, paths: str | list[str], job_id: str | Column | None = None, max_files: int = V.MAX_FILES, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """RAW rows of ZIP files in any file system: each is a job of its own, named after the
    file, unless job_id says otherwise."""
    raw = spark.read.format("binaryFile").load(paths)
    stem = F.regexp_extract("path", r"([^/]*?)(\.[zZ][iI][pP])?$", 1)
    job = stem if job_id is None else F.lit(job_id) if isinstance(job_id, str) else job_id
    archives = raw.select(job.alias("job_id"), F.col("path").alias("name"), "content")
    # one archive is one task to unpack; what comes after is dealt by file
    return unpack(archives, max_files, max_bytes)


def zipped(files: DataFrame, by: str = "job_id") -> DataFrame:
    """The other way: an archive (job_id, name, content) of the files (path, source) of each
    job.  A job's files are in one task's memory, as an archive's bytes are."""

    def run(key, rows):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, source in sorted(zip(rows.column("path").to_pylist(), rows.column("source").to_pylist(), strict=True)):
                z.writestr(zipfile.ZipInfo(path), source or "")
        job = str(key[0].as_py())
        return pa.table({"job_id": [job], "name": [f"{job}.zip"], "content": pa.array([out.getvalue()], pa.binary())})

    return files.select(F.col(by).cast("string").alias("job_id"), "path", "source").groupBy("job_id").applyInArrow(run, "job_id string, name string, content binary")
