"""Tables that a job writes into the shared folder and reads again, and their end."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_TABLES: set[str] = set()
_JVM: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine if all of
    Spark runs in this process, as in tests; on a cluster, where executors would not see each other's files, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="quern-"))
    return _OWN[0]


def written(df: DataFrame, tag: str, by: Sequence[str] = ()) -> DataFrame:
    """`df` written as Parquet into the shared folder, partitioned `by` columns, and read back: lineage is cut, any executor can
    read it again. It is deleted by discard(), by release() or at the driver's end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    if not _JVM:
        atexit.register(_clean)
    _JVM[:] = [spark._jvm, spark._jsc.hadoopConfiguration()]
    _TABLES.add(path)
    return out


def _clean() -> None:
    """At the driver's end; no DataFrame that reads these tables outlives the driver."""
    for path in list(_TABLES):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone already; then the folder's owner has to clean it
            return


def _delete(path: str) -> None:
    jvm, conf = _JVM
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    _TABLES.discard(path)


def release() -> None:
    """Deletes all tables that written() has left, in a driver that lives on. No DataFrame that reads one may be used afterwards."""
    if _JVM:
        _clean()


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote. Nothing may read it afterwards."""
    path = getattr(df, "_quern_path", None)
    if path:
        _delete(path)


class Scratch:
    """Tables that only a part of a job needs: written like written(), deleted together when that part is done."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def written(self, df: DataFrame, tag: str, by: Sequence[str] = ()) -> DataFrame:
        out = written(df, tag, by)
        self.held.append(out)
        return out

    def discard(self) -> None:
        while self.held:
            discard(self.held.pop())
