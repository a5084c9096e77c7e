"""Outputs of several parts that appear all at once.

Parts are written into a new version folder; only then a small pointer file is
replaced, in one step. Who reads through the pointer sees the whole old version
or the whole new one, wherever the writing job died. Old versions stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "CURRENT"


def _step(name: str, write: Callable[[], None]) -> None:
    """One write of a commit."""
    write()


def _path(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that appears, or replaces the one there, in one step."""
    aside, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    files = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 1)
    over[0] = getattr(files, "Options$Rename").OVERWRITE
    files.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(files.Path(path)), over)


def get(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if there is none."""
    own, fs = _path(spark, path)
    if not fs.exists(own):
        return None
    stream = fs.open(own)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def commit(spark: SparkSession, out: str, report: Callable[[str], None] | None, parts: dict[str, Callable[[str], None]]) -> str:
    """Writes the report, then all parts, then a manifest, then the pointer; gives the version's folder.

    report and each part get the path to write to: reports/<version> and
    versions/<version>/<part> under out.
    """
    version = uuid.uuid4().hex
    folder = f"{out.rstrip('/')}/versions/{version}"
    if report:
        _step("report", lambda: report(f"{out.rstrip('/')}/reports/{version}"))
    for name, write in parts.items():
        _step(name, lambda write=write, name=name: write(f"{folder}/{name}"))
    _step("manifest", lambda: put(spark, f"{folder}/manifest.json", json.dumps({"version": version, "parts": list(parts)})))
    _step("pointer", lambda: put(spark, f"{out.rstrip('/')}/{POINTER}", version))
    return folder


def current(spark: SparkSession, out: str) -> str | None:
    """The folder of the version that holds now; None before the first one."""
    version = get(spark, f"{out.rstrip('/')}/{POINTER}")
    return version and f"{out.rstrip('/')}/versions/{version}"
