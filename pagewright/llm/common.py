"""What the operators of this subpackage share: reading tables, shared storage, folds, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all of it runs on this machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="pagewright-"))
    return _own_dir[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already; the shared folder's owner clears the rest
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._pagewright_path = path
    return out


def read_all(tables: list[DataFrame]) -> DataFrame:
    """Tables of one shape that written() made, as one table."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._pagewright_path for t in tables))


def drop(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    path = df.__dict__.get("_pagewright_path")
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of the highest counts, `most` at most; where too many share a count (to one part in 64 of an octave), none of these.

    A histogram of bounded size finds the least count to keep, so no task sorts rows or sends more than are kept.
    """
    at = F.floor(F.log2(F.col(n)) * 64)
    room, least = most, None
    for r in counts.groupBy(at.alias("at")).count().orderBy(F.desc("at")).collect():
        if (room := room - r["count"]) < 0:
            break
        least = r["at"]
    return counts.where(at >= least) if least is not None else counts.limit(0)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The same for bytes in Python: bytes.split() splits at exactly the white space that WORD leaves out.
ASCII_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
