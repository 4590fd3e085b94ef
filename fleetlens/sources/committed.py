"""Tables that grow by commits: cache entries, log rows, parsed files.

A table is a folder: ``data`` has a folder of Parquet files for each append, ``manifests`` a small file for each version
that lists the data folders of that version. An append writes its data aside and counts from the moment its manifest has
its name; that renaming fails if another writer took the version first, and is then tried again upon the newer list. What
isn't in the newest manifest (of a writer that died, or a task that ran twice) is never read. Readers plan on one version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DATA, MANIFESTS = "data", "manifests"


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """The path, its file system, and the context whose renaming never replaces a file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where = where.getFileSystem(conf).makeQualified(where)
    return where, where.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)


def _newest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    where, files, _ = _files(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(where, MANIFESTS)
    if not files.exists(folder):
        return 0, []
    versions = [int(name[:-5]) for f in files.listStatus(folder) if (name := f.getPath().getName()).endswith(".json")]
    if not versions:
        return 0, []
    newest = max(versions)
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{newest:012d}.json"))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return newest, json.loads(text)


def _commit(spark: SparkSession, path: str, change) -> int:  # noqa: ANN001
    """Makes ``change`` of the list of folders the newest version; its number."""
    where, files, context = _files(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    for _ in range(100):
        version, folders = _newest(spark, path)
        aside, target = Path(where, f"aside-{uuid.uuid4().hex}"), Path(Path(where, MANIFESTS), f"{version + 1:012d}.json")
        files.mkdirs(target.getParent())
        out = files.create(aside, False)
        out.write(json.dumps(change(folders)).encode())
        out.close()
        try:
            context.rename(aside, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            files.delete(aside, False)
            if "FileAlreadyExists" not in str(e):
                raise
        else:
            return version + 1
    raise RuntimeError(f"{path}: another writer took every version")


def write_aside(df: DataFrame, path: str) -> str:
    """Writes rows that don't count yet; the name of their folder."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/{DATA}/{name}")
    return name


def commit(spark: SparkSession, path: str, name: str) -> int:
    """From now on the folder's rows count; a second commit of the same name changes nothing."""
    return _commit(spark, path, lambda folders: folders if name in folders else [*folders, name])


def append(df: DataFrame, path: str) -> int:
    return commit(df.sparkSession, path, write_aside(df, path))


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of the newest version; a table that has none yet is empty."""
    folders = _newest(spark, path)[1]
    return spark.read.schema(schema).parquet(*(f"{path}/{DATA}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def newest(rows: DataFrame, key: str, *at: str) -> DataFrame:
    """One row for each key: the one that is latest by these columns. Rows without a key go."""
    rest = [c for c in rows.columns if c != key]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) if rows.schema[c].dataType.simpleString() == "string" else F.col(c) for c in at))).alias("_x"))
    return last.select(*(F.col(c) if c == key else F.col(f"_x.{c}") for c in rows.columns))


def compact(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Makes ``rows``, which were made of this table, all that counts; appends by others meanwhile stay."""
    seen = set(_newest(spark, path)[1])
    name = write_aside(rows, path)
    return _commit(spark, path, lambda folders: [name, *(f for f in folders if f not in seen)])
