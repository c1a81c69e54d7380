"""The data behind each figure, one row per point, ready to plot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetlake.constants import METRIC_COLUMNS, PREFERRED_CODES
from jetlake.functions import text
from jetlake.operators import results as res
from jetlake.operators.grouping import checked_broadcast, ordinals


def figure_series(df: DataFrame, select_by=None, split_by=(), plot_by=("code",), x="mean_particles",
                  y="time_per_event", labels=None) -> DataFrame:
    """Selected rows as points of lines in facets.

    Sorted by facet, line and x.  Columns: the facet keys and ``facet_no``, the line keys, ``series_no`` (its
    order within the facet) and ``series_label``, then ``x`` and ``y``.
    """
    split_by, plot_by = list(split_by), list(plot_by)
    rows = res.select_rows(df, select_by)
    rows = ordinals(rows, split_by, "facet_no")
    rows = ordinals(rows, [*split_by, *plot_by], "_line")
    first = rows.groupBy("facet_no").agg(F.min("_line").alias("_first"))
    rows = rows.join(checked_broadcast(first), "facet_no")
    label = F.concat_ws(" ", *[text.value_label(F.col(c), dict(df.dtypes)[c]) for c in plot_by])
    if labels:
        label = text.code_label(F.col("code"), labels)
    keys = list(dict.fromkeys([*split_by, *plot_by]))
    return rows.select(
        *keys, "facet_no", (F.col("_line") - F.col("_first") + 1).cast("int").alias("series_no"),
        label.alias("series_label"), F.col(x).alias("x"), F.col(y).alias("y")).orderBy("facet_no", "series_no", "x")


def scan_series(summary: DataFrame, metric="efficiency", split_by="input_file",
                group_by="algorithm,strategy,R,p", ideal=True) -> DataFrame:
    """Thread-scan lines: split, series, threads, value; and the ideal line of each split."""
    metric = metric.lower()
    if metric not in METRIC_COLUMNS:
        raise ValueError(f"invalid metric '{metric}'; valid metrics are: {', '.join(METRIC_COLUMNS)}")
    group = [c.strip() for c in group_by.split(",") if c.strip()]
    split = None if split_by.lower() == "none" else split_by
    column = METRIC_COLUMNS[metric]
    res.require_columns(summary, ["threads", column, *group, *([split] if split else [])])
    shown = text.basename(F.col(split)) if split == "input_file" else (
        text.value_label(F.col(split), dict(summary.dtypes)[split]) if split else F.lit("all"))
    lines = summary.select(
        shown.alias("split"), text.row_label(summary, group).alias("series"),
        F.col("threads"), F.col(column).alias("value"))
    in_order = ["split", "series", "threads"]  # the points of a line by their threads
    if not ideal or metric == "throughput":
        return lines.orderBy(*in_order)
    y = F.col("threads").cast("double") if metric == "speedup" else F.lit(1.0)
    reference = lines.select("split", F.lit("ideal").alias("series"), "threads").distinct().withColumn("value", y)
    return lines.unionByName(reference).orderBy(*in_order)


def radius_scan(df: DataFrame, algorithms=None, strategies=None) -> DataFrame:
    """Facets by radius, lines by code in the preferred order, for each algorithm and strategy."""
    rows = res.select_rows(df, algorithm=algorithms, strategy=strategies)
    rows = rows.where(F.col("code").isin(*PREFERRED_CODES))
    points = figure_series(rows, None, ["algorithm", "strategy", "radius"], ["code"])
    return points.withColumn("series_no", text.code_order(F.col("code")).cast("int"))


def showcase(df: DataFrame, algorithm="Kt", radius=2.0, strategy="N2Tiled", without=()) -> DataFrame:
    """Time against density per code for one setting, codes in the preferred order."""
    rows = df.where(res.condition(algorithm=algorithm, radius=radius, strategy=strategy))
    rows = rows.where(F.col("code").isin(*[c for c in PREFERRED_CODES if c not in without]))
    return rows.select(
        "code", text.code_order(F.col("code")).cast("int").alias("series_no"),
        text.code_label(F.col("code")).alias("series_label"),
        F.col("mean_particles").alias("x"), F.col("time_per_event").alias("y"))


def ratio_series(df: DataFrame, numerator, denominator, keys, density="mean_particles") -> DataFrame:
    """Runtime ratio against density for equal settings."""
    ratios = res.runtime_ratio(df, numerator, denominator, [*keys, density])
    return ratios.select(*keys, F.col(density).alias("x"), F.col("ratio").alias("y"))


def latency_series(df: DataFrame, trial: str, columns) -> DataFrame:
    """Value per trial and code, from one column per code."""
    return df.unpivot([trial], list(columns), "code", "value")


def scaling_series(df: DataFrame, strong: int, weak_value: float, keys=()) -> DataFrame:
    """Actual and perfect event rate by thread count, as rows of (series, threads, rate)."""
    scaled = res.ideal_scaling(df, strong, weak_value, keys)
    return scaled.withColumnsRenamed({"event_rate": "actual"}).unpivot(
        [*keys, "threads"], ["actual", "perfect"], "series", "rate")


def speedup_series(df: DataFrame, columns, threads="threads") -> DataFrame:
    """Speedup against the fewest threads for each time column, and the ideal line."""
    long = df.unpivot([threads], list(columns), "series", "time")
    lines = res.speedup_from_first(long, ["series"], "time", threads).select("series", threads, "speedup")
    ideal = df.select(F.lit("ideal").alias("series"), threads, F.col(threads).cast("double").alias("speedup"))
    return lines.unionByName(ideal.distinct())


def version_comparison(releases: dict[str, DataFrame], **figure) -> DataFrame:
    """Several releases of the same table in one figure, lines told apart by ``release``."""
    parts = [df.withColumn("release", F.lit(name)) for name, df in releases.items()]
    plot_by = [*figure.pop("plot_by", ["code"]), "release"]
    return figure_series(res.append_results(parts), plot_by=plot_by, **figure)
