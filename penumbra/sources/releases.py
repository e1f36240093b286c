"""Releases of tables: versioned folders, and one small pointer file that says which of them is current."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Name of the pointer, and of the folder that versions are in.
POINTER, VERSIONS = "CURRENT", "versions"


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()


def _path(spark: SparkSession, name: str):
    return _hadoop(spark)[0].fs.Path(name)


def _exists(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return path.getFileSystem(_hadoop(spark)[1]).exists(path)


def _write_text(spark: SparkSession, name: str, text: str) -> None:
    path = _path(spark, name)
    out = path.getFileSystem(_hadoop(spark)[1]).create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, name: str) -> str:
    path = _path(spark, name)
    stream = path.getFileSystem(_hadoop(spark)[1]).open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """One rename that overwrites: readers see the old file or the new one."""
    hadoop, conf = _hadoop(spark)
    context = hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), conf)
    options = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    options[0] = hadoop.fs.Options.Rename.OVERWRITE
    context.rename(_path(spark, source), _path(spark, target), options)


def current_release(spark: SparkSession, root: str) -> str | None:
    """Folder of the current release; None before the first."""
    pointer = f"{root.rstrip('/')}/{POINTER}"
    return f"{root.rstrip('/')}/{VERSIONS}/{_read_text(spark, pointer).strip()}" if _exists(spark, pointer) else None


def publish_release(spark: SparkSession, root: str, write, check, version: str | None = None) -> str:
    """Write a version of its own, check what is read back, and only then let the pointer name it.

    ``write(folder)`` writes tables below the folder, ``check(folder)`` says whether they are whole. However
    this ends, the pointer names a whole release, as it changes in one rename after everything else is done; what a
    failed call leaves behind is a folder that nothing names.
    """
    root, version = root.rstrip("/"), version or uuid.uuid4().hex
    folder, draft = f"{root}/{VERSIONS}/{version}", f"{root}/.{POINTER}-{version}"
    if _exists(spark, folder):
        raise ValueError(f"there is a version {version} already")
    write(folder)
    if not check(folder):
        raise ValueError("the new release does not verify")
    _write_text(spark, draft, version)
    _replace(spark, draft, f"{root}/{POINTER}")
    return folder


def drop_old_releases(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete versions other than the current one and the ``keep`` - 1 written last; their names."""
    root = root.rstrip("/")
    current = (current_release(spark, root) or "").rsplit("/", 1)[-1]
    top = _path(spark, f"{root}/{VERSIONS}")
    fs = top.getFileSystem(_hadoop(spark)[1])
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(top)), reverse=True) if fs.exists(top) else []
    others = [name for _, name in found if name != current]
    gone = others[max(0, keep - 1) :]
    for name in gone:
        fs.delete(_path(spark, f"{root}/{VERSIONS}/{name}"), True)
    return gone
