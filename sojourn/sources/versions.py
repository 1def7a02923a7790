"""Stored tables that change in one step: parquet folders that never change, and one small file per version naming them.

::

    <root>/data/<folder>/<column>=<value>/*.parquet     written once, by one load
    <root>/versions/<number>.json                       the folders of every partition, and the load that made it
    <root>/loads/<digest of the load id>.json           the version a load aimed at

A load writes new folders where no reader looks. Renaming the file of the next version into place makes all of them
visible at once; until then, and if the load fails at any point, readers find the version before. A load id is done once the
version it aimed at carries it, so that a repeated load can be told from a new one. The folders of a version grow with its
partitions, which a caller bounds (months, ranges of keys), not with its rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sojourn.session import CODEC

NULL_PART = "__HIVE_DEFAULT_PARTITION__"


class VersionConflict(RuntimeError):
    """Another load published the next version first; run the load again."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: Folders below ``data`` by partition, as ``column=value``.
    parts: Mapping[str, list[str]] = field(default_factory=dict)
    load: str | None = None
    #: What the table's owner wants to keep with the version.
    info: Mapping[str, Any] = field(default_factory=dict)


def part_name(column: str, value: object | None) -> str:
    return f"{column}={NULL_PART if value is None else value}"


def hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = hadoop_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def load_json(spark: SparkSession, path: str) -> dict | None:
    fs, at = hadoop_path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def store_json(spark: SparkSession, path: str, content: dict | list[dict]) -> None:
    """One object, or several with a line each; under a name of its own first where no reader may see half a file."""
    text = "\n".join(json.dumps(line) for line in (content if isinstance(content, list) else [content]))
    fs, at = hadoop_path(spark, path)
    fs.mkdirs(at.getParent())
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def _rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename that fails if the target exists."""
    jvm = spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(paths[0].toUri(), spark._jsc.hadoopConfiguration())
    context.rename(*paths, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))


def _version_file(root: str, number: int) -> str:
    return f"{root}/versions/{number:012d}.json"


def _load_file(root: str, load: str) -> str:
    return f"{root}/loads/{hashlib.sha256(load.encode()).hexdigest()}.json"


def version(spark: SparkSession, root: str, number: int) -> Version | None:
    found = load_json(spark, _version_file(root, number))
    return Version(number, found["parts"], found["load"], found["info"]) if found else None


def current(spark: SparkSession, root: str) -> Version:
    """The last version; number 0 without partitions for a table that nothing was loaded into."""
    numbers = [int(name[:-5]) for name in _names(spark, f"{root}/versions") if name.endswith(".json") and name[:-5].isdigit()]
    return (version(spark, root, max(numbers)) if numbers else None) or Version()


def find_load(spark: SparkSession, root: str, load: str) -> Version | None:
    """The version that a finished load made; None for a load that is new or failed before its version was published."""
    aimed = load_json(spark, _load_file(root, load))
    found = version(spark, root, aimed["version"]) if aimed else None
    return found if found and found.load == load else None


def new_folder() -> str:
    """A folder name no other attempt uses."""
    return uuid.uuid4().hex


def write_rows(rows: DataFrame, root: str, folder: str, by: str) -> None:
    """Adds rows to a folder of an unfinished load."""
    rows.write.mode("append").partitionBy(by).parquet(f"{root}/data/{folder}", compression=CODEC)


def folder_parts(spark: SparkSession, root: str, folder: str) -> list[str]:
    """Partitions a folder holds."""
    return [name for name in _names(spark, f"{root}/data/{folder}") if "=" in name]


def read_folder(spark: SparkSession, root: str, folder: str, schema: StructType) -> DataFrame:
    return read_parts(spark, root, Version(parts={name: [folder] for name in folder_parts(spark, root, folder)}), schema)


def read_parts(spark: SparkSession, root: str, at: Version, schema: StructType, only: Iterable[str] | None = None) -> DataFrame:
    """Rows of a version, of the partitions ``only`` if given. The schema is without the partition column."""
    names = at.parts if only is None else [name for name in only if name in at.parts]
    paths = [f"{root}/data/{folder}/{name}" for name in names for folder in at.parts[name]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def publish(
    spark: SparkSession, root: str, base: Version, parts: Mapping[str, list[str]], load: str, info: Mapping[str, Any] | None = None
) -> Version:
    """Makes the version after ``base``: its partitions with those of ``parts`` replaced, dropped where the list is empty."""
    number = base.number + 1
    merged = {name: list(folders) for name, folders in {**base.parts, **parts}.items() if folders}
    made = Version(number, merged, load, dict(info or {}))
    store_json(spark, _load_file(root, load), {"load": load, "version": number})
    staged = f"{root}/versions/_{uuid.uuid4().hex}"
    store_json(spark, staged, {"load": load, "parts": merged, "info": made.info})
    try:
        _rename_new(spark, staged, _version_file(root, number))
    except Exception as failed:
        fs, at = hadoop_path(spark, staged)
        if fs.exists(at):
            fs.delete(at, False)
        if fs.exists(hadoop_path(spark, _version_file(root, number))[1]):
            raise VersionConflict(f"version {number} of {root} exists already") from failed
        raise
    return made


def drop_folders(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes data folders that only versions before the last ``keep`` name; returns their names.

    Folders of unfinished loads are in no version and stay. Version files stay too, as the record of finished loads.
    """
    last = current(spark, root).number
    named = {number: version(spark, root, number) for number in range(1, last + 1)}
    folders = {n: {f for found in v.parts.values() for f in found} for n, v in named.items() if v}
    wanted = {f for n, found in folders.items() if n > last - keep for f in found}
    unused = {f for found in folders.values() for f in found}.intersection(_names(spark, f"{root}/data")) - wanted
    for folder in unused:
        fs, at = hadoop_path(spark, f"{root}/data/{folder}")
        fs.delete(at, True)
    return sorted(unused)
