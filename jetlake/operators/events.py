"""Event rows: assembling them, filtering their particles, windows of events."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jetlake.operators.grouping import checked_broadcast, fixed, join_on

FINAL_STATE = 1


def assemble_events(particles: DataFrame, keys=("file", "event"), order="idx", final_only=False,
                    columns=("px", "py", "pz", "e")) -> DataFrame:
    """One row per event from one row per particle, inputs in ``order``.

    The single shuffle is by event, so a file of any size spreads over all
    tasks; an event is the unit that clustering needs together.  Flat rows with
    only ``columns`` are exchanged, and the lists are built after the exchange.
    """
    if final_only:
        particles = particles.where(F.col("status") == FINAL_STATE)
    fields = [order, *[c for c in columns if c != order]]
    rows = particles.select(*keys, *fields).repartition(*keys)
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("particles"))


def final_state(events: DataFrame) -> DataFrame:
    """Keep the final-state particles of each event; events may become empty."""
    return events.withColumn(
        "particles", F.filter("particles", lambda p: p["status"] == FINAL_STATE))


# Cuts of a file's event numbers, and how many numbers one task should rank.
CUTS, RANGE_ROWS = 255, 65_536


def _ranges(numbers: DataFrame, keys, range_rows) -> DataFrame:
    """Per file: its cuts, plain event numbers that divide them into ranges of about equal size.

    The cuts are approximate quantiles, so it does not matter how the numbers are
    spread; small files need none.
    """
    shares = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    found = numbers.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("event", shares, 20_000).alias("_shares"))
    cuts = F.when(F.col("_n") > range_rows, F.array_distinct("_shares")).otherwise(F.array().cast("array<bigint>"))
    return found.select(*keys, cuts.alias("_cuts"))


def _ranged(events: DataFrame, cuts: DataFrame, keys) -> DataFrame:
    """Events with the number of their range: how many cuts lie below, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(CUTS.bit_length() - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get("_cuts", at + step - 1) < F.col("event"), at + step).otherwise(at))
    return join_on(events, cuts, keys).withColumn("_range", below).drop("_cuts")


def _starts(ranged: DataFrame, keys) -> DataFrame:
    """How many events of the file lie in a range and before it; a file has few ranges."""
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def _numbers(events: DataFrame, keys, range_rows):
    """The event numbers as a table of their own, the cuts of each file, and the sizes of its ranges."""
    numbers = fixed(events.select(*keys, F.col("event").cast("long").alias("event")))
    cuts = checked_broadcast(_ranges(numbers, keys, range_rows))
    ranged = _ranged(numbers, cuts, keys)
    return ranged, cuts, checked_broadcast(_starts(ranged, keys))


def nth_events(events: DataFrame, places: dict[str, int], keys=("file",), range_rows=RANGE_ROWS) -> DataFrame:
    """Event numbers by their place in each file: one column per name in ``places``.

    The events are read once, for their numbers.  Ranges of numbers are counted
    first; only those that hold a wanted place are ranked.  Files without that
    many events have NULL.
    """
    keys = list(keys)
    ranged, _, starts = _numbers(events, keys, range_rows)
    wanted = F.filter(F.array(*[F.lit(n).cast("bigint") for n in places.values()]),
                      lambda n: (F.col("_start") < n) & (F.col("_start") + F.col("_n") >= n))
    holding = starts.select(*keys, "_range", "_start", wanted.alias("_wanted")).where(F.size("_wanted") > 0)
    inside = join_on(ranged, holding, [*keys, "_range"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("event"))
    ranked = inside.withColumn("_place", F.col("_start") + rank).where(F.array_contains("_wanted", F.col("_place")))
    return ranked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_place") == n, F.col("event"))).alias(name) for name, n in places.items()])


def event_window(events: DataFrame, max_events=None, skip_events=0, keys=("file",),
                 range_rows=RANGE_ROWS) -> DataFrame:
    """Per file: cap at ``max_events`` events first, then drop ``skip_events``.

    A negative cap is no cap.  Event numbers are unique in their file.  The events
    are read twice: their numbers, to look up the boundary events of each file,
    and whole, to be filtered in place.
    """
    if skip_events < 0:
        raise ValueError("skip_events must not be negative")
    if max_events == 0:
        return events.limit(0)
    places = {}
    if skip_events:
        places["_skip"] = skip_events
    if max_events is not None and max_events > 0:
        places["_last"] = max_events
    if not places:
        return events
    keys = list(keys)
    kept = join_on(events, checked_broadcast(nth_events(events, places, keys, range_rows)), keys, "left")
    if skip_events:
        # Files with fewer events have no such event, and nothing left.
        kept = kept.where(F.col("event") > F.col("_skip"))
    if "_last" in places:
        kept = kept.where(F.col("_last").isNull() | (F.col("event") <= F.col("_last")))
    return kept.drop(*places)


def event_positions(events: DataFrame, keys=("file",), range_rows=RANGE_ROWS) -> DataFrame:
    """Add ``position``: 1-based order of each event number within its file.

    Rows are ranked inside their range of event numbers only, so one large file
    is ranked by many tasks, however sparse its numbers are.
    """
    keys = list(keys)
    _, cuts, starts = _numbers(events, keys, range_rows)
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("event"))
    return (join_on(_ranged(events, cuts, keys), starts.drop("_n"), [*keys, "_range"])
            .withColumn("position", F.col("_start") + rank).drop("_range", "_start"))


def require_events(events: DataFrame) -> DataFrame:
    """Fail when no event is left, as a run over nothing is an input error."""
    if events.isEmpty():
        raise ValueError("no events left to process")
    return events


def placed_by_cost(events: DataFrame, buckets: int, particles="particles") -> DataFrame:
    """Spread event rows over ``buckets`` tasks of about equal cost ahead of clustering.

    The cost of an event is the square of its particle count.  Counts are counted
    (a small table, as there are few), laid end to end by their share of the whole
    cost and cut into buckets: a frequent or costly count spans several, its events
    salted over them, and rare small ones share one.
    """
    size = F.size(particles)
    cost = F.col("_events") * F.greatest(F.col("_size"), F.lit(1)).cast("double") ** 2
    counts = fixed(events.select(F.coalesce(size, F.lit(0)).alias("_size")).groupBy("_size").agg(F.count("*").alias("_events")))
    total = counts.agg(F.sum(cost)).first()[0] or 1.0
    upto = Window.orderBy("_size").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("_end", F.sum(cost).over(upto) / total * buckets)
    last = F.least(F.greatest(F.ceil(F.col("_end")) - 1, F.lit(0)), F.lit(buckets - 1))
    first = F.least(F.floor(F.col("_end") - cost / total * buckets), last)
    spans = ends.select("_size", F.greatest(first, F.lit(0)).alias("_first"), last.alias("_last"))
    rows = events.withColumn("_size", F.coalesce(size, F.lit(0))).join(checked_broadcast(spans), "_size")
    salt = F.pmod(F.xxhash64(*[c for c in ("file", "event") if c in events.columns] or [particles]), F.col("_last") - F.col("_first") + 1)
    rows = rows.withColumn("_bucket", (F.col("_first") + salt).cast("int"))
    return rows.repartitionById(buckets, "_bucket").drop("_size", "_first", "_last", "_bucket")


def map_events(events: DataFrame, function, schema) -> DataFrame:
    """Apply a function to Arrow-backed pandas batches of event rows."""
    return events.mapInPandas(function, schema)


