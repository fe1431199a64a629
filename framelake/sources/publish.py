"""Staged writing, publishing by rename, snapshots with digests, and a table of results by content; on any file system that Spark reaches."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of the JVM."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Sorted paths of the directories in a directory."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a pattern."""
    fs, p = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def datasets_under(spark: SparkSession, root: str) -> list[str]:
    """The root if it is a dataset, else its children that are; none is an error."""
    if exists(spark, f"{root}/meta/info.json"):
        return [root]
    found = [c for c in children(spark, root) if exists(spark, f"{c}/meta/info.json")]
    if not found:
        raise FileNotFoundError(f"{root}: no meta/info.json")
    return found


def contained(root: str, path: str) -> str:
    """A path relative to a root, joined and normalised; one that leaves the root is an error."""
    whole = posixpath.normpath(posixpath.join(root, path))
    if whole != posixpath.normpath(root) and not whole.startswith(posixpath.normpath(root).rstrip("/") + "/"):
        raise ValueError(f"{path} is outside {root}")
    return whole


def publish(spark: SparkSession, target: str, write: Callable[[str], None], check: Callable[[str], None] | None = None, replace: bool = False) -> None:
    """Calls ``write`` with a staging path beside the target, then ``check``, then renames it to the target.

    An existing target is an error, or with ``replace`` set aside and deleted after the rename, and put back if that fails. Staging is
    deleted on failure, so the target is always a whole old or a whole new one.
    """
    if exists(spark, target) and not replace:
        raise FileExistsError(target)
    tag = uuid.uuid4().hex
    staging, aside = f"{target}.staging-{tag}", f"{target}.old-{tag}"
    fs, final = _path(spark, target)
    _, staged = _path(spark, staging)
    _, old = _path(spark, aside)
    try:
        write(staging)
        if check:
            check(staging)
        held = fs.exists(final)
        if held and not replace:
            raise FileExistsError(target)
        if held and not fs.rename(final, old):
            raise OSError(f"can't set {target} aside")
        if not fs.rename(staged, final):
            if held:
                fs.rename(old, final)
            raise OSError(f"can't rename {staging} to {target}")
        if held:
            fs.delete(old, True)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)


def single_file(write: Callable[[str], None], target: str, spark: SparkSession) -> None:
    """Calls ``write`` (which writes one part) with a staging folder beside the target and renames its part to the target, which must not exist."""
    if exists(spark, target):
        raise FileExistsError(target)
    staging = f"{posixpath.dirname(target)}/.staging-{uuid.uuid4().hex}"
    write(staging)
    fs, staged = _path(spark, staging)
    parts = [s.getPath() for s in fs.listStatus(staged) if s.getPath().getName().startswith("part-")]
    try:
        if len(parts) != 1 or not fs.rename(parts[0], _path(spark, target)[1]):
            raise OSError(f"can't write {target} as one file")
    finally:
        fs.delete(staged, True)


def renamed(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Renames files, making folders; a target that exists is an error. Only names pass through the driver."""
    for source, target in moves:
        fs, old = _path(spark, source)
        _, new = _path(spark, target)
        fs.mkdirs(new.getParent())
        if fs.exists(new) or not fs.rename(old, new):
            raise OSError(f"can't rename {source} to {target}")


def removed(spark: SparkSession, path: str) -> None:
    fs, found = _path(spark, path)
    fs.delete(found, True)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path below the root, length, sha256) of every file."""
    fs, p = _path(spark, root)
    from framelake.sources.datasets import digests  # datasets are written by way of this module

    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    below = F.substring_index(F.col("path"), base, -1)
    return digests(spark, root).select(below.alias("path"), "length", "sha256")


def files_under(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path, bytes) of every file at or under a path, sorted; only names come to the driver."""
    fs, p = _path(spark, root)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen()))
    return sorted(out)


#: Bytes that a task reads at once.
CHUNK = 1 << 22


def _store(path: str) -> tuple[Any, str]:
    """The file system of a path, and its place there, for tasks; one that pyarrow can't open is an error."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _copied(batches: Iterator[Any]) -> Iterator[Any]:
    import pyarrow as pa

    for batch in batches:
        out = []
        for below, source, target in zip(*(batch.column(c).to_pylist() for c in ("path", "source", "target")), strict=True):
            (a, old), (b, new) = _store(source), _store(target)
            b.create_dir(posixpath.dirname(new), recursive=True)
            digest, n = hashlib.sha256(), 0
            with a.open_input_stream(old) as held, b.open_output_stream(new) as to:
                while chunk := held.read(CHUNK):
                    digest.update(chunk)
                    to.write(chunk)
                    n += len(chunk)
            out.append((below, n, digest.hexdigest()))
        yield pa.RecordBatch.from_pydict({c: [r[k] for r in out] for k, c in enumerate(("path", "length", "sha256"))}, pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string())]))


def copied(spark: SparkSession, root: str, target: str) -> DataFrame:
    """(path below the root, length, sha256) of every file, copied to ``target`` by tasks a few megabytes at a time when this is run.

    A task that runs again writes its file again. Each file is one row of a distributed list, dealt by its name; no byte passes through the driver.
    """
    fs, p = _path(spark, root)
    base = fs.makeQualified(p).toString().rstrip("/")
    to = _path(spark, target)
    home = to[0].makeQualified(to[1]).toString().rstrip("/")
    found = [(f[len(base) + 1 :], f, f"{home}/{f[len(base) + 1 :]}") for f, _ in files_under(spark, base)]
    listed = spark.createDataFrame(found, "path string, source string, target string")
    tasks = max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(tasks, "path").mapInArrow(_copied, "path string, length long, sha256 string")


def _footers(batches: Iterator[Any]) -> Iterator[Any]:
    import pyarrow as pa
    from pyarrow import parquet

    for batch in batches:
        schemas, errors = [], []
        for file in batch.column("file").to_pylist():
            try:
                fs, place = _store(file)
                schema = parquet.read_schema(place, filesystem=fs)
                schemas.append(json.dumps([[f.name, str(f.type)] for f in schema]))
                errors.append(None)
            except (OSError, pa.ArrowInvalid) as broken:
                schemas.append(None)
                errors.append(str(broken))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("file"), pa.array(schemas, pa.string()), pa.array(errors, pa.string())], ["path", "file", "schema", "error"])


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file, schema, error) of every Parquet file at or under each path: names and types of its columns as JSON, or what is wrong with it. Tasks read the footers."""
    found = [(p, f) for p in paths for f, _ in files_under(spark, p) if f.endswith(".parquet")]
    listed = spark.createDataFrame(found, "path string, file string")
    return listed.repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism)), "file").mapInArrow(_footers, "path string, file string, schema string, error string")


def snapshot(spark: SparkSession, root: str, target: str) -> bool:
    """Copies a dataset once, with its manifest beside it; false if the copy exists already. A copy that differs from its source is an error.

    Tasks copy the files and digest what they read; then the source and the copy are digested again by Spark and compared with that.
    """
    if exists(spark, target):
        return False

    def written(staging: str) -> None:
        copied(spark, root, f"{staging}/data").write.parquet(f"{staging}/manifest")

    def same(staging: str) -> None:
        listed = spark.read.parquet(f"{staging}/manifest").select("path", "sha256").where("path not rlike '(^|/)[_.]'")  # Spark's own marks aren't data
        for found in (manifest(spark, root), manifest(spark, f"{staging}/data")):
            seen = found.select("path", "sha256")
            if listed.exceptAll(seen).limit(1).count() or seen.exceptAll(listed).limit(1).count():
                raise ValueError(f"{root} changed while it was copied")

    publish(spark, target, written, same)
    return True


def content_key(**parts: Any) -> str:
    """The digest of all that a result depends on: code version, input digest, rules. Numbers must be finite."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, allow_nan=False).encode()).hexdigest()


def _intact(spark: SparkSession, path: str) -> bool:
    """Whether a stored result's parts are those of its manifest, byte by byte; Spark's tasks digest them."""
    listed, found = spark.read.parquet(f"{path}/_manifest"), manifest(spark, path).select("path", "length", "sha256")
    return not listed.exceptAll(found).limit(1).count() and not found.exceptAll(listed).limit(1).count()


def cached(spark: SparkSession, root: str, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A result stored under its key with a manifest of its parts' digests, computed once.

    A stored result is served if its parts are those of the manifest; one without its marks, with parts lost, added or changed, is computed again and
    replaced. Of two writers of one new key the first to publish is served to both.
    """
    path = f"{root}/{key}"
    broken = exists(spark, path)
    if broken and exists(spark, f"{path}/_SUCCESS") and exists(spark, f"{path}/_manifest/_SUCCESS") and _intact(spark, path):
        return spark.read.parquet(path)

    def written(staging: str) -> None:
        compute().write.parquet(staging)
        manifest(spark, staging).select("path", "length", "sha256").write.parquet(f"{staging}/_manifest")

    try:
        publish(spark, path, written, replace=broken)
    except FileExistsError:
        if not _intact(spark, path):
            raise
    return spark.read.parquet(path)
