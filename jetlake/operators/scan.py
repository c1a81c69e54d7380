"""Thread scans: one row shape for all inputs, medians per setting, speedup."""

import os
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jetlake.constants import (DEFAULT_CODE, DEFAULT_JSON_BACKEND, DEFAULT_SCHEDULE, SCAN_METRICS,
                               SCAN_ROW, WORKLOAD)
from jetlake.functions import text
from jetlake.operators.grouping import checked_broadcast, first_values, join_on, quantiles
from jetlake.operators.results import require_columns
from jetlake.sources import tables

GROUP = (*WORKLOAD, "threads", "schedule")
ATTRIBUTES = tuple(c for c, _ in SCAN_ROW if c not in GROUP and c not in SCAN_METRICS
                   and c not in ("source_file", "source_format"))


def scan_rows(df: DataFrame, values: dict) -> DataFrame:
    """Rows of the fixed scan schema; columns without a value are NULL.

    ``_order`` keeps the input order of the rows.
    """
    return df.select(*[
        values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in SCAN_ROW
    ], F.col("_order"))


def json_rows(runs: DataFrame) -> DataFrame:
    """Scan rows of successful thread-run documents (medians of their samples)."""
    c = F.col
    wall = c("summary.wall_time_seconds_median")
    package = c(f"packages.{DEFAULT_CODE}")
    julia = text.text_or(c("julia_version"), "unknown")
    allocated = c("summary.allocated_bytes_total_median")
    same = ("R", "p", "input_event_count", "measured_events", "nsamples", "repeats", "warmup_events",
            "benchmark_command", "package_commit")
    values = {name: c(name) for name in same}
    values |= {name: text.text_or(c(name), "unknown") for name in ("algorithm", "strategy", "input_file")}
    values |= {name: c(f"hardware.{name}") for name in
               ("cpu_threads", "cpu_model", "machine", "kernel", "total_memory_bytes")}
    values |= {
        "source_file": c("source_file"), "source_format": F.lit("json"),
        "code": text.text_or(c("code"), DEFAULT_CODE),
        "code_version": text.text_or(c("code_version"), F.coalesce(package["version"], F.lit("unknown"))),
        "backend": text.text_or(c("backend"), DEFAULT_JSON_BACKEND),
        "backend_version": text.text_or(c("backend_version"), julia),
        "threads": F.coalesce(c("threads"), c("julia_threads")),
        "schedule": text.text_or(c("schedule"), DEFAULT_SCHEDULE),
        "events_per_second": c("summary.events_per_second_median"),
        "julia_version": julia, "wall_time_seconds": wall,
        "time_per_event_seconds": F.coalesce(
            c("summary.time_per_event_seconds_median"), text.divide_or_null(wall, c("measured_events"))),
        "allocated_bytes_total": allocated,
        "allocated_bytes_per_event": text.divide_or_null(allocated, c("measured_events")),
        "gc_fraction": c("summary.gc_fraction_median"),
        "repo_commit": c("git.commit"), "repo_short_commit": c("git.short_commit"),
        "repo_branch": c("git.branch"), "repo_dirty": c("git.is_dirty"),
        "remote_origin": c("git.remote_origin"),
        "jetreconstruction_version": package["version"], "jetreconstruction_source": package["source"],
        "julia_project": c("runtime.julia_project"),
        "julia_num_gc_threads": c("runtime.environment.JULIA_NUM_GC_THREADS"),
        "julia_exclusive": c("runtime.environment.JULIA_EXCLUSIVE"),
    }
    known = F.when(c("success").isNull(), F.raise_error(F.concat(F.lit("no success field in "), c("source_file"))))
    return scan_rows(runs.where(known.otherwise(c("success"))), values)


def skipped_runs(runs: DataFrame) -> DataFrame:
    """The documents that the merge leaves out because their run failed: source_file."""
    return runs.where(~F.col("success")).select("source_file")


def csv_rows(results: DataFrame, name="results") -> DataFrame:
    """Scan rows of a benchmark result table (times in microseconds per event)."""
    present = set(results.columns)
    c = F.col
    required = ["time_per_event", "code", "algorithm", "strategy", "radius", "power", "threads"]
    sources = [f for f in ("File_path", "input_file", "File") if f in present]
    if "_names" in present:
        # Rows of several files: each is held to its own header.
        for column in required:
            if column not in present:
                results = results.withColumn(column, F.lit(None).cast("string"))
        lacking = F.array_except(F.array(*map(F.lit, required)), "_names")
        named = [(F.array_contains("_names", f), c(f)) for f in sources]
        known = named[0][0] if named else F.lit(False)
        for has, _ in named[1:]:
            known = known | has
        problem = F.when(F.size(lacking) > 0, F.concat(F.lit(" lacks column(s) "), F.array_join(lacking, ", "))).when(
            ~known, F.lit(" names no input file column (File_path, input_file or File)"))
        checked = F.when(problem.isNull(), True).otherwise(F.raise_error(F.concat(c("source_file"), problem)).cast("boolean"))
        results = results.where(checked)
        source = F.lit(None).cast("string")
        for has, column in reversed(named):
            source = F.when(has, column).otherwise(source)
    else:
        require_columns(results, required, name)
        if not sources:
            raise ValueError(f"{name} names no input file column (File_path, input_file or File)")
        source = c(sources[0])

    def optional(column):
        return c(column) if column in present else F.lit(None).cast("string")

    seconds = text.positive_or_null(c("time_per_event")) * F.lit(1e-6)
    code = text.text_or(c("code"), "unknown")
    version = text.text_or(optional("backend_version"), "unknown")
    return scan_rows(results, {
        "source_file": optional("source_file"), "source_format": F.lit("csv"),
        "code": code, "code_version": text.text_or(optional("code_version"), "unknown"),
        "backend": text.text_or(optional("backend"), text.default_backend(code)),
        "backend_version": version, "julia_version": version, "threads": c("threads"),
        "schedule": text.schedule_label(code, optional("schedule")),
        "events_per_second": F.lit(1.0) / seconds, "time_per_event_seconds": seconds,
        "algorithm": text.text_or(c("algorithm"), "unknown"),
        "strategy": text.text_or(c("strategy"), "unknown"),
        "R": c("radius"), "p": c("power"), "input_file": text.text_or(source, "unknown"),
        "nsamples": optional("n_samples"),
    })


def read_scan(spark, paths, output=None) -> DataFrame:
    """Scan rows of a mixed list of thread-run JSON files and result CSV files: one scan for each format."""
    json_paths, csv_paths = tables.split_by_format(paths, output)
    known = checked_broadcast(spark.createDataFrame([(_absolute(p), n) for n, p in enumerate(paths)], "_path string, _file int"))
    parts = []
    if json_paths:
        runs = tables.read_thread_runs(spark, json_paths)
        placed = runs.withColumns({
            "_path": _path_key(F.col("_metadata.file_path")), "_block": F.col("_metadata.file_block_start"),
            "_row": F.monotonically_increasing_id()}).join(known, "_path", "left")
        parts.append(json_rows(placed.withColumn("_order", _place())))
    if csv_paths:
        raw = tables.read_csv_files(spark, csv_paths).withColumn("source_file", F.col("_path"))
        placed = raw.withColumn("_path", _path_key(F.col("_path"))).join(known, "_path", "left")
        parts.append(csv_rows(tables.typed(placed.withColumn("_order", _place()))))
    if not parts:
        raise ValueError("no input rows to merge")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _place():
    return F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_row").alias("row"))


def _path_key(path):
    """A path without scheme and authority."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _absolute(path: str) -> str:
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)
    return bare if bare.startswith("/") else os.path.abspath(bare)


def merge_scan(rows: DataFrame, order="_order") -> DataFrame:
    """Medians per workload, thread count and schedule; first known attributes; row counts."""
    known = [c for c in ATTRIBUTES if c in rows.columns]
    merged = quantiles(rows, GROUP, SCAN_METRICS, [0.5], extra=[F.count("*").alias("raw_rows")])
    merged = join_on(merged, first_values(rows, GROUP, known, order), GROUP, "left")
    return merged.select(
        *GROUP, *[F.col(f"{m}_q0").alias(f"{m}_median") for m in SCAN_METRICS],
        *known, "raw_rows")


def with_speedup(merged: DataFrame, strict=True) -> DataFrame:
    """Speedup and efficiency against the one-thread rows of the same workload.

    The baseline is the median over the schedules measured with one thread.
    With ``strict``, a workload without a baseline is an error.
    """
    # One row per thread count and schedule is left of each workload.
    single = F.when(F.col("threads") == 1, F.col("events_per_second_median"))
    joined = merged.withColumn(
        "baseline_events_per_second_median", F.median(single).over(Window.partitionBy(*WORKLOAD)))
    b = F.col("baseline_events_per_second_median")
    if strict:
        missing = F.raise_error(F.lit("cannot compute speedup: a workload has no 1-thread baseline"))
        joined = joined.withColumn(
            "baseline_events_per_second_median", F.when(b.isNull(), missing.cast("double")).otherwise(b))
    speedup = text.ratio(F.col("events_per_second_median"), b)
    return joined.withColumn("speedup_median", speedup).withColumn(
        "efficiency_median", text.ratio(F.col("speedup_median"), F.col("threads")))


def sorted_scan(summary: DataFrame) -> DataFrame:
    return summary.orderBy(*[F.col(c).asc_nulls_last() for c in (*WORKLOAD, "schedule", "threads")])


def scan_summary(spark, paths, output=None) -> DataFrame:
    """The whole merge: mixed files to a sorted table of medians, speedup and efficiency."""
    rows = read_scan(spark, paths, output)
    if rows.isEmpty():
        raise ValueError("no successful run to merge")
    return sorted_scan(with_speedup(merge_scan(rows)))
