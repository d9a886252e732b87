"""Writing results: one file or a folder of CSV or Parquet, audit documents, backups; anywhere that Hadoop's file systems reach."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import PurePath

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame

from ..session import PrismataError, session

BACKUP = ".prismata-backup"
#: Bytes that are copied at once when parts are joined.
COPY_BYTES = 1 << 20


def _fs(path: str):
    spark = session()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _drop_checksum(fs, at) -> None:
    """The checksum that local file systems keep beside a file: it would be stale once another tool edits the file."""
    beside = session()._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.crc")
    if fs.exists(beside):
        fs.delete(beside, False)


def _replace(fs, made, goal) -> None:
    """Puts what was made in the goal's place; what was there is moved aside first and deleted last, so that a crash loses neither."""
    aside = session()._jvm.org.apache.hadoop.fs.Path(goal.getParent(), f".{goal.getName()}.{uuid.uuid4().hex}.old")
    had = fs.exists(goal)
    if had and not fs.rename(goal, aside):
        raise PrismataError(f"can't replace {goal}")
    try:
        done = fs.rename(made, goal)
    except Py4JJavaError:  # some file systems raise, others say no
        done = False
    if not done:
        if had:
            fs.rename(aside, goal)
        raise PrismataError(f"can't write {goal}")
    if had:
        fs.delete(aside, True)


def is_folder(path: str) -> bool:
    fs, at = _fs(path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def _parts(fs, folder) -> list:
    """The files that the tasks wrote, in the order of the frame's partitions."""
    found = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    return sorted(found, key=lambda f: int(f.getName().split("-")[1]))


def _joined(fs, parts: list, path: str, head: bytes):
    """One file of the head and the parts' bytes, streamed from store to store by the JVM."""
    jvm = session()._jvm
    made = jvm.org.apache.hadoop.fs.Path(path)
    stream = fs.create(made, True)
    try:
        stream.write(bytearray(head))
        for part in parts:
            source = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, COPY_BYTES, False)
            finally:
                source.close()
    finally:
        stream.close()
    return made


def _cell(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(x in name for x in ',"\r\n') else name


def write_table(df: DataFrame, path: str, single: bool = True) -> str:
    """CSV or Parquet by extension; ``single`` makes one file, else the folder that Spark writes in parallel.

    One CSV file is written by many tasks too, and their parts are joined byte by
    byte in the order of the frame; one Parquet file is written by one task.  What
    was there stays until the new output is whole.
    """
    work = f"{path}.{uuid.uuid4().hex}.part"
    (fs, at), (_, goal) = _fs(work), _fs(path)
    parquet = path.lower().endswith((".parquet", ".arrow"))
    try:
        if parquet:
            (df.coalesce(1) if single else df).write.parquet(work)
        else:
            df.write.csv(work, header=not single, quote='"', escape='"')
        if not single:
            _replace(fs, at, goal)
            return path
        parts = _parts(fs, at)
        head = (",".join(_cell(c) for c in df.columns) + "\n").encode()
        _replace(fs, parts[0] if parquet else _joined(fs, parts, f"{work}/joined", head), goal)
    finally:
        if fs.exists(at):
            fs.delete(at, True)
    _drop_checksum(fs, goal)
    return path


def write_audit(out_path: str, audit: dict) -> str:
    path = os.path.splitext(out_path)[0] + ".audit.json"
    if "://" not in out_path and os.path.dirname(os.path.realpath(path)) != os.path.dirname(os.path.realpath(out_path)):
        raise PrismataError("audit file would leave the output's folder")
    fs, at = _fs(path)
    stream = fs.create(at, True)
    stream.write(bytearray(json.dumps(audit, indent=2, ensure_ascii=False).encode()))
    stream.close()
    _drop_checksum(fs, at)
    return path


def _copy(source: str, goal: str) -> None:
    spark = session()
    (fs, a), (_, b) = _fs(source), _fs(goal)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, fs, b, False, spark._jsc.hadoopConfiguration()):
        raise PrismataError(f"can't copy {source} to {goal}")
    _drop_checksum(fs, b)


def backup(path: str) -> str:
    """Copies the file or folder beside itself, once: a later call keeps the first copy."""
    copy = path + BACKUP
    fs, at = _fs(copy)
    if not fs.exists(at):
        _copy(path, copy)
    return copy


def restore(path: str) -> str:
    (fs, copy), (_, at) = _fs(path + BACKUP), _fs(path)
    if not fs.exists(copy):
        raise PrismataError(f"no backup of {PurePath(path).name}")
    if fs.exists(at):
        fs.delete(at, True)
    _drop_checksum(fs, at)
    fs.rename(copy, at)
    _drop_checksum(fs, at)
    return path
