"""Shared folders, tables written to cut lineage, and files written by tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on one machine, where that may be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quoteloom-"))
    return _own[0]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/quoteloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and read again after lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df_or_path: DataFrame | str, spark: SparkSession) -> None:
    """Delete a written table or folder that nothing reads any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else list({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def join_one(rows: DataFrame, side: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row for each ``key`` and, as ``size``, how many rows have it.

    Keys of more than a thousandth of all ``total`` rows, a thousand keys at
    most, are broadcast: no task gets all rows of a common key.  The others meet
    by an ordinary join.
    """
    most = max(16, total // 1000)
    given = [c for c in side.columns if c not in (key, size)]
    often = F.broadcast(side.where(F.col(size) > most).select(F.col(key).alias("_often"), *given))
    common = rows.join(often, F.col(key) == F.col("_often")).select(*rows.columns, *given)
    rest = rows.join(often.select("_often"), F.col(key) == F.col("_often"), "left_anti")
    return common.unionByName(rest.join(side.where(F.col(size) <= most).select(key, *given), key).select(*rows.columns, *given))


#: Bits of the filter by which rows that surely stay are told from others: 4,096 maps of 4,096 bytes.
FILTER_MAPS, MAP_BITS = 4096, 32_768


def suspected(docs: DataFrame, id_column: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose id surely isn't among ``ids`` (one column of longs), and the others.

    The filter is a bit for each hash of an id, 16 MB at most, and is broadcast:
    no text moves.  With very many ids it lets more rows be suspected, never fewer.
    """

    def slot(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(FILTER_MAPS * MAP_BITS))

    name, bits = free_name(docs, "_map"), free_name(docs, "_bits")
    at, own = slot(F.col(ids.columns[0])), slot(id_column)
    maps = ids.select((at / MAP_BITS).cast("int").alias(name), (at % MAP_BITS).alias("_bit")).groupBy(name).agg(F.bitmap_construct_agg("_bit").alias(bits))
    marked = docs.join(F.broadcast(written(maps, "id-filter")), (own / MAP_BITS).cast("int") == F.col(name), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (own % MAP_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), own % 8).cast("int")) != 0, F.lit(False))
    every = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~hit).select(*every), marked.where(hit).select(*every)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 4096, size: int = 4_000_000) -> None:
    """Bound Arrow batches to Python by bytes as well as rows, as texts may be long.

    Settings of the user's own that are lower stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that others, whatever their names, are never in the way."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if need be, such that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def open_output(uri: str):
    """A binary stream to a new file of a shared folder, from within a task."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """Random access to a file of a shared folder, from within a task."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
