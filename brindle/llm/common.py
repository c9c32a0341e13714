"""Helpers that the operators share: shared folders, files, fresh column names."""

from __future__ import annotations

import functools
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in the tests) a
    temporary folder of this machine is set in its stead.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        base = spark.sparkContext.getCheckpointDir()
    jvm = spark.sparkContext._jvm
    # A path without a scheme lies on the cluster's default file system.
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_fs(uri: str):
    """``(filesystem, path)`` of a URI; file, hdfs, s3 and gs are understood."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def stored(spark: SparkSession, value: object, name: str) -> str:
    """Pickle a value of bounded size into the shared folder; returns its URI.

    Workers that serve many queries hold every broadcast they met; of these
    values they hold the last one.
    """
    uri = shared_dir(spark, name)
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        pickle.dump(value, out, protocol=5)
    return uri


@functools.lru_cache(maxsize=1)
def loaded(uri: str) -> object:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as stream:
        return pickle.loads(stream.read())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``written`` returned and that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


HOT_KEYS, HOT_ROWS = 10_000, 64


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int, times: str = "n", stored: bool = True) -> DataFrame:
    """Inner join of ``left``, which has ``rows`` rows, with ``right``, which has one row a key and says in ``times`` how many rows of ``left`` have it.

    Keys of more than ``rows / HOT_KEYS`` rows, of which there are at most
    ``HOT_KEYS``, are broadcast: their rows of ``left`` stay in the tasks that
    read them. Only rows of the other keys are dealt out by key. ``right`` is
    planned three times for that; where it is ``stored`` (a narrow view of a
    table that ``written`` returned) it is asked for such keys first, and
    without any there is one plain join. The driver holds every plan it ran.
    """
    many = max(HOT_ROWS, rows // HOT_KEYS)
    if stored and right.where(F.col(times) > many).isEmpty():
        return left.join(right.hint("merge"), key)
    hot = F.broadcast(right.where(F.col(times) > many))
    cold = left.join(F.broadcast(right.where(F.col(times) > many).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(cold.join(right.where(F.col(times) <= many).hint("merge"), key))


BITMAP_WORDS = 1 << 18


def perhaps_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``left`` whose key is in ``right``, and a few others.

    A bitmap of the hashes of the keys, broadcast, drops the rest before
    anything moves. It has ``BITMAP_WORDS`` rows of 64 bits at most, whatever
    the data; the more keys there are, the more of the others pass.
    """
    return _by_bitmap(left, right, key, True)


def surely_not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``left`` that ``perhaps_in`` drops."""
    return _by_bitmap(left, right, key, False)


def _by_bitmap(left: DataFrame, right: DataFrame, key: str, inside: bool) -> DataFrame:
    word = fresh(left, "word")
    bits = fresh(left, "bits")
    hashed = F.xxhash64(F.col(f"`{key}`"))
    at, bit = F.shiftrightunsigned(hashed, 46), F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))")
    bitmap = right.select(at.alias(word), bit.alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(bits))
    found = left.withColumn(word, at).join(F.broadcast(bitmap), word, "left")
    has = F.coalesce(F.col(f"`{bits}`"), F.lit(0)).bitwiseAND(bit) != 0
    return found.where(has if inside else ~has).select(*[F.col(f"`{c}`") for c in left.columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out = "_" + out
    return out


def with_string(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``df`` and the name of a string column with the values of ``column``: itself, or a new last one where it is of another type."""
    if df.schema[column].dataType.simpleString() == "string":
        return df, column
    name = fresh(df, "string")
    return df.withColumn(name, F.col(f"`{column}`").cast("string")), name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_SETTING, BATCH_ROWS, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's executors, once for each application.

    Texts are long rows: where the session has Spark's default size of Arrow
    batches, it gets smaller ones, for the sake of executors' memory.
    """
    if spark.conf.get(BATCH_SETTING) == DEFAULT_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        with tempfile.TemporaryDirectory() as held:
            copy = os.path.join(held, "src", os.path.basename(root))
            shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__"))
            spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="brindle-"), "brindle"), "zip", os.path.dirname(copy)))
        _SHIPPED.add(app)


_SHIPPED: set[str] = set()


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query``, whose first argument is a session, with the package sent ahead."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
