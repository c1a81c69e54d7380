"""Selecting, appending and comparing benchmark result tables."""

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetlake.functions import text
from jetlake.operators.grouping import checked_broadcast, join_on, ordinals, quantiles


def require_columns(df: DataFrame, columns, name="table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing required column(s): {', '.join(missing)}")
    return df


def select_rows(df: DataFrame, selector: dict | None = None, **fixed) -> DataFrame:
    """Rows that match all conditions: ``{column: value or list of values}``.

    Unknown columns are ignored with a warning; keywords set to None do not
    restrict.
    """
    wanted = dict(selector or {})
    wanted.update({k: v for k, v in fixed.items() if v is not None})
    for column, value in wanted.items():
        if column not in df.columns:
            warnings.warn(f"{column} is not a column name - ignored", stacklevel=2)
            continue
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        df = df.where(F.col(column).isin(*values))
    return df


def drop_rows(df: DataFrame, column: str, value) -> DataFrame:
    """Remove rows by value; rows with NULL stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def decorate(df: DataFrame, **constants) -> DataFrame:
    """Add the same run metadata to every row."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


_WIDER = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string")


def append_results(parts: list[DataFrame]) -> DataFrame:
    """Stack tables under the first one's columns, widening types where they differ.

    Later tables may have more columns, which are left out, but not fewer.
    """
    first = parts[0]
    for n, part in enumerate(parts[1:], start=2):
        require_columns(part, first.columns, f"table {n}")

    def widest(column):
        kinds = [dict(p.dtypes)[column] for p in parts]
        return max(kinds, key=_WIDER.index) if all(k in _WIDER for k in kinds) else kinds[0]

    types = {c: widest(c) for c in first.columns}
    shaped = [p.select(*[F.col(c).cast(types[c]) for c in first.columns]) for p in parts]
    return reduce(DataFrame.unionByName, shaped)


def with_baseline(df: DataFrame, keys, order: str, value: str) -> DataFrame:
    """Add ``baseline``: the value of the row that comes first by ``order`` in its group."""
    base = df.groupBy(*keys).agg(F.min_by(value, order).alias("baseline"))
    return join_on(df, checked_broadcast(base), list(keys))


def speedup_from_first(df: DataFrame, keys, time: str, threads="threads") -> DataFrame:
    """t(first row) / t, the first row being the one with fewest threads."""
    return with_baseline(df, keys, threads, time).withColumn(
        "speedup", text.ratio(F.col("baseline"), F.col(time))).drop("baseline")


def ideal_scaling(df: DataFrame, strong: int, weak_value: float, keys=(), rate="event_rate",
                  threads="threads") -> DataFrame:
    """Add ``perfect``: linear in the strong cores, a fraction more for each weak one."""
    keys = list(keys)
    if not keys:
        return ideal_scaling(df.withColumn("_all", F.lit(0)), strong, weak_value, ["_all"], rate, threads).drop("_all")
    n, one = F.col(threads), F.col("baseline")
    cores = F.when(n <= strong, n.cast("double")).otherwise(
        F.lit(float(strong)) + (n - strong) * F.lit(float(weak_value)))
    return with_baseline(df, keys, threads, rate).withColumn("perfect", one * cores).drop("baseline")


def runtime_ratio(df: DataFrame, numerator, denominator, keys, value="time_per_event",
                  column="code") -> DataFrame:
    """Ratio of two codes' times for equal settings, where both were measured.

    Several rows of one setting count with their minimum, the quantity that the
    tables report.  One aggregation by setting does the pairing.
    """
    def side(code):
        return F.min(F.when(F.col(column) == code, F.col(value)))

    paired = (df.where(F.col(column).isin(numerator, denominator)).groupBy(*keys)
              .agg(side(numerator).alias("num"), side(denominator).alias("den")))
    return paired.where(F.col("num").isNotNull() & F.col("den").isNotNull()).select(
        *keys, text.ratio(F.col("num"), F.col("den")).alias("ratio"))


def ratio_means(ratios: DataFrame, by=("algorithm", "strategy"), split="R", at_least=1.0) -> DataFrame:
    """Arithmetic and geometric mean of ratios: overall, for large ``split``, and per ``split``.

    ``scope`` tells the three apart ('all', 'from_<at_least>', 'each').
    """
    by = list(by)
    tagged = ratios.select(*by, F.col(split).alias("_split"), "ratio").withColumn("_log", F.log("ratio"))
    big = F.col("_split") >= F.lit(at_least)
    means = [F.avg("ratio").alias("mean"), F.exp(F.avg("_log")).alias("geomean"), F.count("*").alias("n")]
    grouped = (tagged.withColumn("_big", big)
               .groupingSets([by, [*by, "_big"], [*by, "_split"]], *by, "_big", "_split")
               .agg(F.grouping_id().alias("_set"), *means))
    scope = F.when(F.col("_set") == 3, "all").when(F.col("_set") == 1, f"from_{at_least}").otherwise("each")
    return (grouped.withColumn("scope", scope)
            .where((F.col("_set") != 1) | F.col("_big"))
            .select("scope", *by, F.col("_split").alias(split), "mean", "geomean", "n"))


def group_means(df: DataFrame, keys, value="time_per_event") -> DataFrame:
    """Mean per group, with the ordinal of the group."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return ordinals(means, keys, "group_no")


def weighted_means(files: DataFrame, weight: str, times: dict[str, str]) -> DataFrame:
    """Weighted mean over all files, as rows of (method, time)."""
    w = F.col(weight)
    sums = files.agg(*[
        F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w))).alias(m) for m, c in times.items()])
    return sums.unpivot([], list(times), "method", "time")


def fastest_per_jet(samples: DataFrame, keys=("file", "method"), time="seconds", jets="n_jets") -> DataFrame:
    """Smallest time per jet over the samples, in microseconds."""
    return samples.groupBy(*keys).agg(F.min(text.ratio(F.col(time) * F.lit(1e6), F.col(jets))).alias("time_per_jet"))


def lookup_one(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Join a table that must hold each key of ``df`` exactly once."""
    rest = [c for c in table.columns if c != key]
    single = table.groupBy(key).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in rest])
    joined = join_on(df, single, [key], "left")
    ok = F.coalesce(F.col("_n"), F.lit(0)) == 1
    bad = F.raise_error(F.concat(F.lit(f"{key} must match exactly one row: "), F.col(key).cast("string")))
    return joined.withColumn("_n", F.when(~ok, bad.cast("int")).otherwise(F.lit(1))).where("_n = 1").drop("_n")


def describe(df: DataFrame, columns) -> DataFrame:
    """One row per numeric column: count, missing, min, median, mean, max."""
    columns = list(columns)
    wide = quantiles(df, [], columns, [0.5], extra=[
        F.count("*").alias("_rows"),
        *[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns
          for f, n in ((F.min, "min"), (F.avg, "mean"), (F.max, "max"))]])
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"{c}_n").alias("count"),
        (F.col("_rows") - F.col(f"{c}_n")).alias("missing"), F.col(f"{c}_min").alias("min"),
        F.col(f"{c}_q0").alias("median"), F.col(f"{c}_mean").alias("mean"),
        F.col(f"{c}_max").alias("max")) for c in columns])
    return wide.select(F.inline(rows))


def top_of(df: DataFrame, a: str, b: str) -> DataFrame:
    """The largest value of two columns and its ceiling."""
    return df.agg(F.greatest(F.max(a), F.max(b)).alias("top")).withColumn("ceiling", F.ceil("top"))


def head(df: DataFrame, order, n=5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


def group_count(df: DataFrame, keys) -> DataFrame:
    """Number of distinct groups, NULL being a value like any other."""
    return df.select(*keys).distinct().agg(F.count("*").alias("n_groups"))


def in_preferred_order(df: DataFrame, column="code", then=(), preferred=None) -> DataFrame:
    place = text.code_order(F.col(column), preferred) if preferred else text.code_order(F.col(column))
    return df.where(place > 0).orderBy(place, *[F.col(c).asc_nulls_last() for c in then])


def condition(**equal) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in equal.items()])
