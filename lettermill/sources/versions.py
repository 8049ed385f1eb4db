"""Tables in versions: appends go to the version in force; a compacted one is written aside and put in force by one rename.

``<path>/CURRENT`` names the version in force, ``<path>/v<n>`` holds its rows. A failure before the rename leaves the earlier
version as it is; its leftovers are overwritten by the next attempt. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a version from which on it is compacted.
LIMIT = 8 << 20


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, path: str) -> int:
    """The version in force, 0 if nothing was ever written."""
    fs, pointer = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(pointer):
        return 0
    return int(spark.read.text(f"{path}/CURRENT").first()[0].strip().removeprefix("v"))


def _switch(spark: SparkSession, path: str, to: int) -> None:
    """Put a version in force: the pointer is written aside and renamed over the old one."""
    fs, aside = _fs(spark, f"{path}/.CURRENT.{to}")
    out = fs.create(aside, True)
    out.write(bytearray(f"v{to}\n".encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    overwrite[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(aside, _fs(spark, f"{path}/CURRENT")[1], overwrite)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version in force."""
    now = version(spark, path)
    if not now:
        raise FileNotFoundError(f"no version is in force in {path}")
    return spark.read.parquet(f"{path}/v{now}")


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the version in force."""
    fs, p = _fs(spark, f"{path}/v{version(spark, path)}")
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def append(rows: DataFrame, path: str, shorten: Callable[[DataFrame], DataFrame] | None = None, limit: int = LIMIT) -> bool:
    """Add rows to the version in force; if it then has over ``limit`` bytes, compact it by ``shorten``. True if it was compacted."""
    spark = rows.sparkSession
    now = version(spark, path)
    rows.write.mode("append").parquet(f"{path}/v{now or 1}")
    if not now:
        _switch(spark, path, 1)
    if shorten is None or size(spark, path) <= limit:
        return False
    compact(spark, path, shorten)
    return True


def compact(spark: SparkSession, path: str, shorten: Callable[[DataFrame], DataFrame]) -> int:
    """Write what ``shorten`` leaves of the rows as a new version, then put it in force. The earlier version's files stay, for readers that have begun."""
    now = version(spark, path)
    shorten(read(spark, path)).write.mode("overwrite").parquet(f"{path}/v{now + 1}")
    _switch(spark, path, now + 1)
    return now + 1


def clear(spark: SparkSession, path: str) -> None:
    """Delete the files of earlier versions."""
    now = version(spark, path)
    fs, p = _fs(spark, path)
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.startswith("v") and name != f"v{now}":
            fs.delete(f.getPath(), True)
