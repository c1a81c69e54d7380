"""Statistics of benchmark trials."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetlake.constants import TIMING_STATS
from jetlake.functions.text import ratio
from jetlake.operators.grouping import checked_broadcast, fixed, join_on, quantiles

STATS = ("n_samples", *TIMING_STATS)


def trial_stats(df: DataFrame, keys, value="time_us", largest=None) -> DataFrame:
    """n_samples, mean, std, median, min, max, q25, q75, iqr of each group.

    The standard deviation of a single trial is 0.
    """
    v = F.col(value).cast("double")
    stats = quantiles(df, keys, [value], [0.25, 0.5, 0.75], extra=[
        F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max")], largest=largest)
    return stats.select(
        *keys, F.col(f"{value}_n").alias("n_samples"), "mean", "std", F.col(f"{value}_q1").alias("median"),
        "min", "max", F.col(f"{value}_q0").alias("q25"), F.col(f"{value}_q2").alias("q75"),
        (F.col(f"{value}_q2") - F.col(f"{value}_q0")).alias("iqr"))


def within_band(df: DataFrame, stats: DataFrame, keys, value="time_us", band=2.0) -> DataFrame:
    """Rows within ``band`` interquartile ranges of their group's quartiles, ends included."""
    keys = list(keys)
    reach = F.lit(float(band)) * F.col("iqr")
    limits = stats.select(*keys, (F.col("q25") - reach).alias("_low"), (F.col("q75") + reach).alias("_high"))
    kept = join_on(df, checked_broadcast(limits), keys)
    return kept.where(F.col(value).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def reject_outliers(df: DataFrame, keys, value="time_us", band=2.0) -> DataFrame:
    return within_band(df, trial_stats(df, keys, value), keys, value, band)


def outlier_statistics(df: DataFrame, keys, value="time_us", band=2.0) -> DataFrame:
    """Full and outlier-excluded statistics of each group, told apart by ``selection``."""
    full = fixed(trial_stats(df, keys, value))
    largest = full.agg(F.max("n_samples")).first()[0] or 0
    kept = trial_stats(within_band(df, full, keys, value, band), keys, value, largest)
    return full.withColumn("selection", F.lit("full")).unionByName(
        kept.withColumn("selection", F.lit("outlier_excluded")))


def trial_histogram(df: DataFrame, keys, value="time_us", max_bins=80) -> DataFrame:
    """Counts per bin of a Freedman-Diaconis histogram: bin, low, high, count."""
    keys = list(keys)
    v = F.col(value).cast("double")
    stats = quantiles(df, keys, [value], [0.25, 0.75], extra=[F.min(v).alias("_min"), F.max(v).alias("_max")])
    iqr = F.col(f"{value}_q1") - F.col(f"{value}_q0")
    width = F.ceil(F.lit(2.0) * iqr / F.pow(F.col(f"{value}_n"), F.lit(1.0 / 3.0))).cast("double")
    width = F.when(width <= 0, F.lit(1.0)).otherwise(F.coalesce(width, F.lit(1.0)))
    spread = F.col("_max") - F.col("_min")
    stats = stats.select(*keys, "_min", width.alias("_width"), spread.alias("_spread"))
    bins = F.least(F.greatest(F.ceil(F.col("_spread") / F.col("_width")), F.lit(1)), F.lit(max_bins)).cast("int")
    stats = stats.select(*keys, "_min", bins.alias("n_bins"),
                         # Equal bins over the range; a single value gets one bin of the nominal width.
                         F.when(F.col("_spread") > 0, F.col("_spread") / bins).otherwise(F.col("_width")).alias("_w"))
    rows = join_on(df.where(F.col(value).isNotNull()).select(*keys, value), checked_broadcast(stats), keys)
    number = F.least(F.floor((v - F.col("_min")) / F.col("_w")), F.col("n_bins") - 1).cast("int")
    counted = rows.groupBy(*keys, "n_bins", "_min", "_w", number.alias("bin")).agg(F.count("*").alias("count"))
    return counted.select(
        *keys, "n_bins", "bin", (F.col("_min") + F.col("bin") * F.col("_w")).alias("low"),
        (F.col("_min") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "count")


def sample_moments(df: DataFrame, keys, value, n_events) -> DataFrame:
    """Mean, sigma and lowest time of whole samples, each per processed event."""
    n = n_events if isinstance(n_events, Column) else F.lit(n_events)
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(v).alias("n_samples"),
        (F.avg(v) / F.max(n)).alias("mean"),
        (F.coalesce(F.stddev_samp(v), F.lit(0.0)) / F.max(n)).alias("sigma"),
        (F.min(v) / F.max(n)).alias("lowest"),
        ratio(F.max(n), F.min(v)).alias("event_rate"))


def sample_metrics(df: DataFrame, time="wall_time_seconds", events="measured_events",
                   allocated="allocated_bytes_total", gc="gc_time_seconds") -> DataFrame:
    """Rates and per-event figures of each sample; in no time the rate is infinite, the GC share 0."""
    t = F.col(time)
    return df.withColumns({
        "events_per_second": ratio(F.col(events), t),
        "time_per_event_seconds": ratio(t, F.col(events)),
        "allocated_bytes_per_event": ratio(F.col(allocated), F.col(events)),
        "gc_fraction": F.when(t == 0, F.lit(0.0)).otherwise(ratio(F.col(gc), t))})


SUMMARY_METRICS = ("wall_time_seconds", "events_per_second", "allocated_bytes_total", "gc_fraction")


def sample_summary(df: DataFrame, keys, metrics=SUMMARY_METRICS) -> DataFrame:
    """min, median, max and iqr of sample metrics per run."""
    found = quantiles(df, keys, metrics, [0.25, 0.5, 0.75], extra=[
        f(F.col(m).cast("double")).alias(f"{m}_{n}") for m in metrics for f, n in ((F.min, "min"), (F.max, "max"))])
    return found.select(*keys, *[
        c for m in metrics for c in (
            F.col(f"{m}_min"), F.col(f"{m}_q1").alias(f"{m}_median"), F.col(f"{m}_max"),
            (F.col(f"{m}_q2") - F.col(f"{m}_q0")).alias(f"{m}_iqr"))])


def best_sample(df: DataFrame, keys, time="wall_time_seconds", index="sample_index", columns=()) -> DataFrame:
    """The fastest sample of each run, the earliest on ties, with its ``columns``."""
    chosen = F.struct(F.col(index), F.col(time), *[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(
        F.min_by(chosen, F.struct(F.col(time), F.col(index))).alias("b")).select(*keys, "b.*")


def result_table(stats: DataFrame, external=False) -> DataFrame:
    """Statistics under the names of a result table.

    The reported time is the minimum.  External tools report nothing else, so
    their other statistics are NULL.
    """
    names = [f"time_per_event_{s}" for s in TIMING_STATS]
    shown = [(F.col(s) if not external or s == "min" else F.lit(None)).cast("double").alias(n)
             for s, n in zip(TIMING_STATS, names)]
    rest = [c for c in stats.columns if c not in STATS]
    return stats.select(*rest, "n_samples", F.col("min").alias("time_per_event"), *shown)
