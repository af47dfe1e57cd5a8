"""File admission: a table of files with a verdict, before anything is parsed."""

from __future__ import annotations

import hashlib
import posixpath
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..plans.shared import written

# Bytes of a file that a task holds at once.
PIECE = 1 << 20


class PathNotAllowed(ValueError):
    """The path lies outside the allowed root; it is not repeated in the message."""


def inside_root(path: str, root: str) -> bool:
    """Compares whole path components after normalising both sides."""
    clean = lambda p: posixpath.normpath(urlparse(p).path or "/")
    child, parent = clean(path), clean(root)
    return child == parent or child.startswith(parent.rstrip("/") + "/")


def _verdict(table: DataFrame, max_bytes: int) -> DataFrame:
    """``table(path, length, sha256, head)`` with extension, accepted and reason; head is the hex of the first four bytes."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    binary = F.col("head").isin(fv.ZIP_HEADER, fv.OLE_HEADER)
    reason = (F.when(F.col("length") == 0, F.lit("empty"))
              .when(F.col("length") > max_bytes, F.lit("too large"))
              .when(F.col("sha256").isNull(), F.lit("unreadable"))
              .when(~ext.isin("csv", "xlsx", "xls"), F.lit("unsupported type"))
              .when((ext == "csv") & binary, F.lit("content is not text"))
              .when((ext == "xlsx") & (F.col("head") != fv.ZIP_HEADER), F.lit("content is not a workbook"))
              .when((ext == "xls") & (F.col("head") != fv.OLE_HEADER), F.lit("content is not a workbook")))
    return table.select("path", "length", ext.alias("extension"), "sha256", reason.isNull().alias("accepted"),
                        F.coalesce(reason, F.lit("ok")).alias("reason"))


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path, the path in it, and what stands before all of the store's paths."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    store, inner = fs.FileSystem.from_uri(path)
    parts = urlparse(path)
    return store, inner, f"{parts.scheme}://{parts.netloc if inner.startswith('/') else ''}"


def _hidden(name: str) -> bool:
    """Names that file scans pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entries(store: fs.FileSystem):
    def work(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = [e for e in store.get_file_info(fs.FileSelector(folder)) if not _hidden(e.base_name)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([e.path for e in found], pa.string()), pa.array([e.size or 0 for e in found], pa.int64()),
                    pa.array([e.type == fs.FileType.Directory for e in found], pa.bool_())], names=["path", "length", "is_folder"])
    return work


def list_files(spark: SparkSession, store: fs.FileSystem, path: str) -> DataFrame:
    """``(path, length)`` of all files below a store's folder, listed in tasks, a level of folders at a time; of a file, itself.

    The driver learns only whether a level holds folders, never a path.  Every level is written, so a lost
    executor repeats one folder's listing at most.
    """
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError("no such file or folder")
    if info.is_file:
        return spark.createDataFrame([(path, info.size)], "path string, length long")
    files, folders = None, spark.createDataFrame([(path,)], "path string")
    while not folders.isEmpty():
        level = written(folders.mapInArrow(_entries(store), "path string, length long, is_folder boolean"), "listing")
        here = level.where("NOT is_folder").select("path", "length")
        files = here if files is None else files.unionByName(here)
        # A folder of many files may follow many of few, so folders are dealt anew.
        folders = level.where("is_folder").select("path").repartition("path")
    return files


def digest_files(files: DataFrame, store: fs.FileSystem) -> DataFrame:
    """``(path, length)`` with sha256 and head, the hex of the first four bytes; both are null where a file cannot be read."""
    def work(batches):
        for batch in batches:
            heads, digests = [], []
            for path in batch.column("path").to_pylist():
                digest, head = hashlib.sha256(), b""
                try:
                    with store.open_input_stream(path) as f:
                        while piece := f.read(PIECE):
                            head = head or bytes(piece[:4])
                            digest.update(piece)
                except OSError:  # gone or closed since it was listed: its row says so, the others go on
                    heads.append(None)
                    digests.append(None)
                else:
                    heads.append(head.hex().upper())
                    digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(heads, pa.string())],
                                             names=["path", "length", "sha256", "head"])

    # Dealt by path, as one folder's files stand together in the listing.
    return files.repartition("path").mapInArrow(work, "path string, length long, sha256 string, head string")


def file_manifest(spark: SparkSession, path: str, allowed_root: str, max_bytes: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """One row per file below a folder: path, length, extension, sha256, accepted, reason.

    Folders are listed and contents read in tasks, in pieces of ``PIECE`` bytes, so neither paths nor contents
    pass the driver and no content is held whole.  Files beyond the size limit are never opened and have no digest;
    a file that cannot be read is rejected as unreadable.  The store has to be one that Arrow opens (a path,
    ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
    """
    if not inside_root(path, allowed_root):
        raise PathNotAllowed("path is outside the allowed root")
    store, inner, prefix = opened(path)
    listed = list_files(spark, store, inner)
    read = digest_files(listed.where(F.col("length") <= max_bytes), store)
    unread = listed.where(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("head"))
    return _verdict(read.unionByName(unread), max_bytes).withColumn("path", F.concat(F.lit(prefix), "path"))
