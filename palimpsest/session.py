"""The shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Where it is unset (tests on one machine) a temporary folder is set for this
    session; on a cluster an unset folder is an error, since a folder of one
    machine would be lost with it.
    """
    named = spark.conf.get(_SETTING, None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder shared by all executors")
        named = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set(_SETTING, named)
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared folder; removed when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = f"{shared_dir(spark)}/palimpsest-{app}"
        atexit.register(_remove, spark, _made[app])
    return _made[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have gone first
        pass


def release(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder so far; tables read from it end with it."""
    app = spark.sparkContext.applicationId
    if app in _made:
        remove(spark, _made[app])


def sweep(spark: SparkSession, older_than_hours: float = 24) -> list[str]:
    """Removes what applications that were killed left in the shared folder: folders in which nothing has changed for so long."""
    where, fs = _hadoop(spark, shared_dir(spark))
    own, now, gone = f"palimpsest-{spark.sparkContext.applicationId}", time.time() * 1000, []
    for found in fs.listStatus(where) if fs.exists(where) else []:
        name = found.getPath().getName()
        if not name.startswith("palimpsest-") or name == own or not found.isDirectory():
            continue
        changed = max([found.getModificationTime(), *(f.getModificationTime() for f in fs.listStatus(found.getPath()))])
        if now - changed > older_than_hours * 3_600_000:
            fs.delete(found.getPath(), True)
            gone.append(name)
    return gone


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: no recomputation, lineage cut."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as scans report it in ``_metadata.file_path``."""
    where, fs = _hadoop(spark, path)
    return where.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString().replace("file:///", "file:/", 1)


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _hadoop(spark, path)
    fs.delete(where, True)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, by Spark's own file systems; none where there is no such folder."""
    where, fs = _hadoop(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def read_file(spark: SparkSession, path: str) -> str:
    """A small text file."""
    return bytes(spark.read.format("binaryFile").load(path).first().content).decode()


def commit_file(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file under a name none has yet, whole or not at all; False where the name is taken."""
    jvm = spark.sparkContext._jvm
    where, fs = _hadoop(spark, path)
    fs.mkdirs(where.getParent())
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rule = jvm.org.apache.hadoop.fs.Options.Rename
    rules = spark.sparkContext._gateway.new_array(rule, 1)
    rules[0] = rule.NONE
    try:
        context.rename(temporary, where, rules)
        return True
    except Exception:
        fs.delete(temporary, False)
        if fs.exists(where):
            return False
        raise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_name(taken: list[str], want: str) -> str:
    """``want``, or a variant of it that clashes with no column."""
    seen = {c.lower() for c in taken}
    name = want
    while name.lower() in seen:
        name = "_" + name
    return name
