"""Writers.  Tables are written in parallel, as directories."""

import urllib.parse
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetlake.operators import events as ev
from jetlake.operators import selection
from jetlake.operators.grouping import byte_width

# About how many bytes one task writes under one name.
FILE_BYTES = 128 << 20
RUN_COLUMNS = ("code", "algorithm", "strategy", "radius", "power")


def write_csv(df: DataFrame, path, mode="errorifexists"):
    df.write.mode(mode).csv(path, header=True)


def write_results(df: DataFrame, path, mode="errorifexists", fmt="parquet"):
    """Result tables, laid out by run parameters so that readers can prune."""
    df.write.mode(mode).partitionBy(*[c for c in RUN_COLUMNS if c in df.columns]).format(fmt).save(path)


def run_name() -> Column:
    """The file name a run's parameters stand for.

    Threads are named when there are several, the schedule only with them.
    """
    c = F.col
    many = c("threads") != 1
    threads = F.when(many, F.concat(F.lit("_T"), c("threads"))).otherwise("")
    schedule = F.when(many & c("schedule").isNotNull(), F.concat(F.lit("_"), c("schedule"))).otherwise("")
    return F.concat(
        c("code"), F.lit("_"), c("code_version"), F.lit("_"), c("algorithm"), F.lit("_"), c("strategy"),
        F.lit("_R"), c("radius"), F.lit("_P"), c("power"), F.lit("_"), c("backend"), F.lit("_"),
        c("backend_version"), threads, schedule, F.lit(".csv"))


def write_jet_documents(selected: DataFrame, path, keep_empty=True, mode="errorifexists"):
    selection.jet_documents(selected, keep_empty).write.mode(mode).json(path)


def write_jet_dump(selected: DataFrame, path, mode="errorifexists"):
    """Text dump of the jets of every event by its processed position, counted from 1 in its file.

    A table without a file column has no such position and keeps its event numbers.
    The parts are ranges of files and positions, so read in the order of their
    names they give all events in order.
    """
    by_file = "file" in selected.columns
    placed, order = (ev.event_positions(selected), ["file", "position"]) if by_file else (selected, ["event"])
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    selection.format_jet_dump(ordered, order[-1]).select("value").write.mode(mode).text(path)


def write_named(df: DataFrame, folder: str, name: Column, fmt="csv", order=(), columns=None, file_bytes=FILE_BYTES):
    """One file per value of ``name`` in ``folder``, under that very name (see ``run_name``).

    Rows are sorted by ``order`` inside a file; ``columns`` are written, all unless named.
    A name whose rows take more than ``file_bytes`` becomes a directory of that name, as
    Spark reads it: its parts are ranges of ``order``, written by several tasks, and hold
    the rows in order when read in the order of their names.

    All files are written aside first by Spark's own committer, so a failed task or
    run leaves nothing under a final name; the driver then renames them, one call
    a name.  A name that is taken is an error before anything is renamed.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    aside = path(f"{folder}/.{uuid.uuid4().hex}")
    files = aside.getFileSystem(conf)
    columns = list(columns or df.columns)
    rows = df.withColumn("_name", name)
    options = {"header": True} if fmt == "csv" else {}

    def write(some: DataFrame, part: str):
        out = some.sortWithinPartitions("_name", *order).select("_name", *columns)
        out.write.partitionBy("_name").format(fmt).options(**options).save(f"{aside.toString()}/{part}")

    def moves(pattern: str, named) -> list:
        found = [status.getPath() for status in files.globStatus(path(f"{aside.toString()}/{pattern}")) or []]
        return [(source, path(f"{folder}/{urllib.parse.unquote(named(source).getName().removeprefix('_name='))}"))
                for source in found]

    try:
        size = sum((byte_width(f.name, f.dataType) for f in df.schema.fields if f.name in columns), F.lit(0))
        # As many rows as names, which the driver renames.
        sizes = rows.groupBy("_name").agg(F.sum(size).alias("bytes")).collect()
        large = [r for r in sizes if r["bytes"] > file_bytes and r["_name"] is not None]
        small = rows
        if large:
            names = F.broadcast(spark.createDataFrame([(r["_name"],) for r in large], "_name string"))
            ranges = list(order) or [F.xxhash64(*[F.col(f"`{c}`") for c in columns])]
            parts = sum(-(-r["bytes"] // file_bytes) for r in large)
            write(rows.join(names, "_name", "left_semi").repartitionByRange(parts, "_name", *ranges), "large")
            small = rows.join(names, "_name", "left_anti")
        if len(large) < len(sizes) or not large:
            write(small.repartition("_name"), "small")
        moved = moves("small/_name=*/part-*", lambda source: source.getParent()) + moves("large/_name=*", lambda source: source)
        taken = [target.getName() for _, target in moved if files.exists(target)]
        if taken or len({target.getName() for _, target in moved}) < len(moved):
            raise FileExistsError(f"names taken in {folder}: {', '.join(taken[:5])}")
        for done, (source, target) in enumerate(moved):
            if not files.rename(source, target):
                for _, earlier in moved[:done]:
                    files.delete(earlier, True)
                raise OSError(f"cannot rename to {target.getName()}")
    finally:
        files.delete(aside, True)


def write_thread_runs(runs: DataFrame, path, mode="errorifexists"):
    runs.write.mode(mode).json(path)
