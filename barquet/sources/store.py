"""Run tables and bar generations as Parquet that Spark reads and writes; validated before anything can see it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.operators import integrity
from barquet.operators.quality import merge_keep_last
from barquet.operators.scans import within
from barquet.schemas import BARS, TABLES, differences

TRIES = 3
GENERATION = 32  #: characters of a generation's name


def save_runs(path: str, tables: dict[str, DataFrame], tolerance: float = 0.02) -> str:
    """Append a batch of runs with their children: all four tables or, if the batch fails its integrity report, none.

    A batch is a folder of its own; what has been written is what is checked, and readers see it once its marker, the last
    thing written, is there.
    """
    wrong = {n: d for n, pinned in TABLES.items() if (d := differences(tables[n].schema, pinned))}
    if wrong:
        raise ValueError(f"not the pinned schema: {wrong}")
    batch, spark = uuid.uuid4().hex, tables["backtest_runs"].sparkSession
    for name, frame in tables.items():
        frame.write.parquet(f"{path}/{name}/batch={batch}")
    kept = {name: spark.read.schema(TABLES[name]).parquet(f"{path}/{name}/batch={batch}") for name in tables}
    failed = integrity.failures(integrity.report(kept, tolerance))
    if failed:
        raise ValueError(f"integrity: {failed}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/_batches")
    return batch


def load_runs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables, of the batches that were finished."""
    done = spark.read.parquet(f"{path}/_batches")
    read = lambda name: spark.read.parquet(f"{path}/{name}").join(F.broadcast(done), "batch", "left_semi").select(*TABLES[name].names)
    return {name: read(name) for name in TABLES}


def _content() -> list[Column]:
    """Number of rows, and two sums of hashes: any other rows, or other numbers of equal ones, give other sums."""
    total = lambda *salt: F.coalesce(F.sum(F.xxhash64(*salt, *BARS.names).cast("decimal(20,0)")).cast("string"), F.lit("0"))
    return [F.count("*").alias("row_count"), F.concat_ws("|", total(), total(F.lit("again"))).alias("content")]


class PublishConflict(RuntimeError):
    """Other writers made a generation the current one each time this one was about to."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and its paths: the store may lie wherever Spark can write."""
    jvm = spark.sparkContext._jvm
    of = jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and generation of every pointer that was written to the end, in order."""
    fs, of = _files(spark, path)
    folder = of(f"{path}/_pointers")
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        if status.getLen() == GENERATION:
            stream = fs.open(status.getPath())
            found.append((int(status.getPath().getName()), bytes(stream.readNBytes(GENERATION)).decode()))
            stream.close()
    return sorted(found)


def _point(spark: SparkSession, path: str, number: int, generation: str) -> bool:
    """Write pointer ``number`` unless there is one: of many writers, one can."""
    fs, of = _files(spark, path)
    try:
        stream = fs.create(of(f"{path}/_pointers/{number:08}"), False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    stream.write(bytearray(generation.encode()))
    stream.close()
    return True


def current_generation(spark: SparkSession, path: str) -> str | None:
    """What readers see: the generation of the last pointer; what a crash left before its pointer is never read."""
    pointers = _pointers(spark, path)
    return pointers[-1][1] if pointers else None


def _next_number(spark: SparkSession, path: str) -> int:
    """One more than any pointer's, also one that a crash left empty."""
    fs, of = _files(spark, path)
    folder = of(f"{path}/_pointers")
    return 1 + max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0) if fs.exists(folder) else 1


def publish_bars(path: str, bars: DataFrame, base: str | None = None, replaced: DataFrame | None = None, check: Callable[[DataFrame], None] | None = None) -> str:
    """Write a new generation of bars and make it the current one. Readers of older generations aren't disturbed.

    ``base`` is the generation that ``bars`` were made from (none: null). If another has become current since, the bars are
    laid over it: all of them, or those of the ranges ``replaced`` (``symbol, start, end``, dates), win over the newer base's
    bars of the same symbol and time, and ``check`` may refuse the result by raising. The pointer is written only if no one else has
    written it meanwhile; after ``TRIES`` attempts in vain, PublishConflict. Until then nothing changes for readers.
    """
    wrong = differences(bars.schema, BARS)
    if wrong:
        raise ValueError(f"not the pinned schema: {wrong}")
    spark = bars.sparkSession
    for _ in range(TRIES):
        number, latest = _next_number(spark, path), current_generation(spark, path)
        whole = bars
        if latest is not None and latest != base:
            own = bars if replaced is None else within(bars, replaced, F.to_date("timestamp"), by=["symbol"])
            whole = merge_keep_last(current_bars(spark, path), own.select(*BARS.names))
        if check is not None:
            check(whole)
        generation = uuid.uuid4().hex
        whole.repartitionByRange("symbol", "timestamp").sortWithinPartitions("symbol", "timestamp").write.parquet(f"{path}/generation={generation}")
        row = spark.read.parquet(f"{path}/generation={generation}").agg(F.lit(generation).alias("generation"), F.lit(latest).cast("string").alias("base"), *_content(), F.current_timestamp().alias("published"))
        row.coalesce(1).write.mode("append").parquet(f"{path}/_generations")
        if _point(spark, path, number, generation):
            return generation
    raise PublishConflict(f"{path}: another generation became current {TRIES} times")


def current_bars(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The current generation; ValueError if there is none, or if its rows aren't those that were published."""
    generation = current_generation(spark, path)
    if generation is None:
        raise ValueError(f"{path}: nothing has been published")
    bars = spark.read.parquet(f"{path}/generation={generation}")
    if verify:
        told = spark.read.parquet(f"{path}/_generations").where(F.col("generation") == generation).first()
        n, content = bars.agg(*_content()).first()
        if (n, content) != (told.row_count, told.content):
            raise ValueError(f"generation {generation} has changed since it was published")
    return bars
