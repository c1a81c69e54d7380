"""Grouping helpers that stay safe when one group holds a large share of the rows."""

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, MapType, NumericType, StringType, StructType

# Small sides are broadcast only after their size was counted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Values that one task may hold to find an exact quantile.
CELL_ROWS = 65_536
# Tables of more than so many times that are reduced by counting before their values meet.
CELLS = 16
# By how many bits a cell of values, or a block of an index, is divided.
BITS = 16


def byte_width(name: str, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    column = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, (ArrayType, StructType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
    return F.lit(16)


def checked_broadcast(small: DataFrame, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> DataFrame:
    """Mark a derived table for broadcast if its rows and bytes are counted to be few.

    A larger table is returned unmarked, so the join shuffles.  The table is
    computed once, for the count; what is joined is its checkpoint.
    """
    kept = fixed(small)
    width = reduce(lambda a, b: a + b, [byte_width(f.name, f.dataType) for f in kept.schema.fields])
    size = kept.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(kept) if size["rows"] <= max_rows and size["bytes"] <= max_bytes else kept


def join_on(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join where NULL keys match each other; keys appear once, from the left.

    Without keys the right side is the one row of a whole-table aggregate.
    """
    if not keys:
        one = F.lit(0)
        return join_on(left.withColumn("_all", one), right.withColumn("_all", one), ["_all"], how).drop("_all")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def quantiles(df: DataFrame, keys, values, probs, extra=(), cell_rows=CELL_ROWS, largest=None) -> DataFrame:
    """Exact quantiles (linear interpolation, NULLs ignored, NaN above all numbers) per group, at any group size.

    Returns the keys, ``{value}_n``, ``{value}_q{i}`` for the i-th probability,
    and the ``extra`` aggregates.  Columns of all-NULL groups are NULL.

    Radix selection: a wanted quantile lies in a cell of values, at first its
    whole group.  While some wanted cell holds more than ``cell_rows`` values, or all
    of them more than ``CELLS`` times that, all are divided by the next 16 bits of the values (see ``ordered_bits``), counted
    by one aggregation that reduces before its exchange.  Cells that one task may
    hold are finished from their values; after 64 bits a cell is one value.  A
    caller that knows a bound on the group size passes it as ``largest`` and saves
    the count by group.  A small table of small groups is one aggregation of its values.
    """
    keys, values, probs, extra = list(keys), list(values), list(probs), list(extra)
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], values, probs, extra, cell_rows, largest).drop("_all")
    if largest is None:
        groups = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
        largest, total = (n or 0 for n in groups.agg(F.max("_rows"), F.sum("_rows")).first())
    else:
        total = df.count() if largest <= cell_rows else largest
    if largest <= cell_rows and total <= CELLS * cell_rows:
        # Every cell is a whole group: its values meet in the aggregate.
        found = df.groupBy(*keys).agg(
            *[F.count(v).alias(f"{v}_n") for v in values],
            *[F.percentile(F.col(v).cast("double"), probs).alias(f"_q_{v}") for v in values], *extra)
        return found.select(
            *[c for c in found.columns if not c.startswith("_q_")],
            *[F.get(f"_q_{v}", F.lit(i)).alias(f"{v}_q{i}") for v in values for i in range(len(probs))])
    totals = df.groupBy(*keys).agg(*[F.count(v).alias(f"{v}_n") for v in values], *extra)
    return join_on(totals, selected(df, keys, values, probs, cell_rows), keys, "left")


_MANTISSA = 1 << 52


def ordered_bits(x: Column) -> Column:
    """A double as a 64-bit integer of the same order: the bits of its size, negated for negative numbers.

    Made by exact arithmetic, as no SQL function gives the bits.  Both zeros are 0.
    """
    size = F.abs(x)
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023))
    # The logarithm may be rounded across a power of two.
    exponent = (guess - F.when(F.pow(F.lit(2.0), guess) > size, 1).otherwise(0)
                + F.when(F.pow(F.lit(2.0), guess + 1) <= size, 1).otherwise(0))
    exponent = F.greatest(F.least(exponent, F.lit(1023)), F.lit(-1022))
    scaled = (size / F.pow(F.lit(2.0), exponent) * F.lit(float(_MANTISSA))).try_cast("long")
    bits = (exponent + 1022).cast("long") * F.lit(_MANTISSA) + scaled
    bits = F.when(size == 0, 0).when(size == float("inf"), 2047 * _MANTISSA).otherwise(bits)
    return F.when(F.isnan(x), 2047 * _MANTISSA + 1).when(x < 0, -bits).otherwise(bits)


def from_ordered_bits(bits: Column) -> Column:
    """The double of ``ordered_bits``."""
    size = F.abs(bits)
    exponent = F.shiftright(size, 52)
    part = size.bitwiseAND(F.lit(_MANTISSA - 1)) / F.lit(float(_MANTISSA))
    normal = (part + 1.0) * F.pow(F.lit(2.0), exponent - 1023)
    value = F.when(exponent == 0, part * F.lit(2.0**-1022)).when(exponent < 2047, normal).when(
        part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(bits < 0, -value).otherwise(value)


def selected(df: DataFrame, keys, values, probs, cell_rows=CELL_ROWS) -> DataFrame:
    """The quantiles alone, by radix selection: keys and ``{value}_q{i}``.

    ``wanted`` has one row per group, value and rank: the cell it lies in, how
    many values of the group lie before that cell and how many in it.
    """
    names = {f"_k{i}": k for i, k in enumerate(keys)}
    keys = list(names)
    cell = [*keys, "v"]
    slim = df.select(*[F.col(k).alias(n) for n, k in names.items()], F.explode(F.array(*[
        F.struct(F.lit(j).alias("v"), F.col(v).cast("double").alias("x")) for j, v in enumerate(values)])).alias("c"))
    rows = slim.select(*keys, "c.v", ordered_bits(F.col("c.x")).alias("bits")).where(F.col("c.x").isNotNull())

    def parts(bits_known):
        return F.shiftright(F.col("bits"), 64 - bits_known) if bits_known else F.lit(0).cast("long")

    counts = fixed(rows.groupBy(*cell).agg(F.count("*").alias("total")))
    places = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("total") - 1) * F.lit(float(p))), F.ceil((F.col("total") - 1) * F.lit(float(p))))
        for p in probs])))
    wanted = counts.select(*cell, F.explode(places).alias("rank"), F.lit(0).cast("long").alias("cell"),
                           F.lit(0).cast("long").alias("before"), F.col("total").alias("size"))
    known = 0

    def large():
        sizes = wanted.select(*cell, "cell", "size").distinct().agg(F.max("size"), F.sum("size")).first()
        return (sizes[0] or 0) > cell_rows or (sizes[1] or 0) > CELLS * cell_rows

    while known < 64 and large():
        ranks = wanted.select(*cell, "cell", "rank", "before").distinct()
        inside = rows.withColumn("cell", parts(known))
        if known:
            inside = join_on(inside, checked_broadcast(ranks.select(*cell, "cell").distinct()), [*cell, "cell"])
        divided = inside.withColumn("part", parts(known + BITS)).groupBy(*cell, "cell", "part").agg(F.count("*").alias("size"))
        earlier = Window.partitionBy(*cell, "cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        opened = join_on(divided.withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0))), ranks, [*cell, "cell"])
        start = F.col("before") + F.col("start")
        wanted = fixed(opened.where((start <= F.col("rank")) & (F.col("rank") < start + F.col("size"))).select(
            *cell, "rank", F.col("part").alias("cell"), start.alias("before"), "size"))
        known += BITS
    if known < 64:
        cells = wanted.select(*cell, "cell").distinct()
        inside = rows.withColumn("cell", parts(known))
        if known:
            inside = join_on(inside, checked_broadcast(cells), [*cell, "cell"])
        held = inside.groupBy(*cell, "cell").agg(F.sort_array(F.collect_list("bits")).alias("held"))
        exact = join_on(wanted, held, [*cell, "cell"]).withColumn(
            "bits", F.get("held", (F.col("rank") - F.col("before")).cast("int")))
    else:
        exact = wanted.withColumn("bits", F.col("cell"))
    at = join_on(exact.select(*cell, "rank", from_ordered_bits(F.col("bits")).alias("x")), counts, cell)

    def quantile(j, p):
        place = (F.col("total") - 1) * F.lit(float(p))
        low, high = (F.max(F.when((F.col("v") == j) & (F.col("rank") == edge(place)), F.col("x"))) for edge in (F.floor, F.ceil))
        above, below = (F.max(F.when(F.col("v") == j, part)) for part in (F.ceil(place) - place, place - F.floor(place)))
        return F.when(low == high, low).otherwise(above * low + below * high)  # as the aggregate has it

    return at.groupBy(*keys).agg(*[
        quantile(j, p).alias(f"{v}_q{i}") for j, v in enumerate(values) for i, p in enumerate(probs)]).withColumnsRenamed(names)


def first_known(column: str, order: Column) -> Column:
    """The first non-NULL value of a column in the given row order (an aggregate)."""
    known = F.col(column).isNotNull()
    return F.min_by(F.col(column), F.when(known, order))


def first_values(df: DataFrame, keys, columns, order, cell_rows=CELL_ROWS) -> DataFrame:
    """Per group the first non-NULL value of each column in the order of the rows: keys and columns.

    Groups without any known value have no row.
    Rows that cannot be first are left out before whole rows are sorted: of a large
    table those stay that have, for some column, the least first field of the order
    among the group's known values, then the least second one, and so on.  The least
    numbers are found by an aggregation that keeps one row a group.
    """
    keys, columns = list(keys), list(columns)
    kind = df.schema[order].dataType
    names = kind.names if isinstance(kind, StructType) else [None]
    kinds = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind]
    rows = df.select(*keys, order, *columns).withColumn("_open", F.array(*[F.col(c).isNotNull() for c in columns]))
    rows = rows.where(F.exists("_open", lambda x: x))
    for name, kind in zip(names, kinds):
        if not isinstance(kind, NumericType) or isinstance(kind, DecimalType) or rows.limit(CELLS * cell_rows + 1).count() <= CELLS * cell_rows:
            break
        field = F.col(order)[name] if name else F.col(order)
        opened = [F.get("_open", F.lit(i)) for i in range(len(columns))]
        # In an order NULL comes before all numbers.
        least = rows.withColumn("_field", field).groupBy(*keys).agg(*[
            a for i, o in enumerate(opened) for a in (
                F.min(F.when(o, F.col("_field"))).alias(f"_m{i}"), F.max(F.when(o, F.col("_field").isNull())).alias(f"_n{i}"))])
        joined = join_on(rows.withColumn("_field", field), checked_broadcast(least), keys)
        still = [o & F.when(F.col(f"_n{i}"), F.col("_field").isNull()).otherwise(F.col("_field").eqNullSafe(F.col(f"_m{i}")))
                 for i, o in enumerate(opened)]
        rows = joined.withColumn("_open", F.array(*still)).where(F.exists("_open", lambda x: x)).select(*keys, order, *columns, "_open")
    return rows.groupBy(*keys).agg(*[first_known(c, F.col(order)).alias(c) for c in columns])


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="jetlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """Write a table out and read it back (a checkpoint), so that every use sees the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(distinct: DataFrame, columns, name: str, max_rows=BROADCAST_ROWS) -> DataFrame:
    """Number the rows of a table of distinct ``columns`` by their sorted order, from 1.

    A counted small table is ranked directly.  A larger one is cut into sorted
    ranges, which are ranked apart and shifted by the sizes of those before.
    """
    order = [F.col(c).asc_nulls_last() for c in columns]
    kept = fixed(distinct)
    if kept.limit(max_rows + 1).count() <= max_rows:
        return kept.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    ranges = fixed(kept.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return join_on(ranges, checked_broadcast(starts), ["_range"]).select(
        *columns, (F.col("_start") + inside).alias(name))


def ordinals(df: DataFrame, columns, name: str, max_rows=BROADCAST_ROWS) -> DataFrame:
    """Add the 1-based sorted position of each distinct combination of ``columns``.

    Only the distinct combinations are numbered; rows look their number up.
    """
    columns = list(columns)
    if not columns:
        return df.withColumn(name, F.lit(1).cast("long"))
    table = numbered(df.select(*columns).distinct(), columns, name, max_rows)
    return join_on(df, checked_broadcast(table, max_rows), columns, "left")


def prefix_min(df: DataFrame, index: str, value: str, keys=(), span_bits=BITS) -> DataFrame:
    """Smallest value, and its first index, over every prefix of an indexed series.

    A scan over blocks in levels: a block of the index is the rows, or the blocks
    of the level below, that share all but the next ``span_bits`` bits of their
    number.  Going up, each block is reduced to its minimum until a series is one
    block; going down, a block looks back over the blocks before it within its
    parent and takes over what came before the parent.  No window is larger than
    a block, whether or not the series has keys.
    """
    keys = list(keys)
    low = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("value"), F.col(index).alias("index")))
    first, last = ((end or 0) >> span_bits for end in df.agg(F.min(index), F.max(index)).first())
    block = F.shiftright(F.col(index).cast("long"), span_bits) - F.lit(first)
    rows = df.withColumn("_block", block).withColumn("_low", low)
    levels = [fixed(rows.groupBy(*keys, "_block").agg(F.min("_low").alias("_low")))]
    blocks = last - first
    while blocks >> span_bits:
        blocks >>= span_bits
        block = F.shiftright("_block", span_bits).alias("_block")
        levels.append(fixed(levels[-1].groupBy(*keys, block).agg(F.min("_low").alias("_low"))))
    before = None
    for level in reversed(levels):
        above = level.withColumn("_parent", F.shiftright("_block", span_bits))
        earlier = Window.partitionBy(*keys, "_parent").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        above = above.withColumn("_inside", F.min("_low").over(earlier))
        if before is not None:
            above = join_on(above, before.withColumnRenamed("_block", "_parent"), [*keys, "_parent"])
            above = above.withColumn("_inside", F.least("_inside", "_before"))
        before = above.select(*keys, "_block", F.col("_inside").alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_on(rows.withColumn("_here", F.min("_low").over(inside)), before, [*keys, "_block"])
    best = F.least("_before", "_here")
    return joined.select(*keys, index, value, best["value"].alias("prefix_min"), best["index"].alias("prefix_index"))
