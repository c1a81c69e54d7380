"""The first recombination step of every event, found by a join of tiles.

A pair is looked for by its owner, the particle of smaller weight (then smaller
number): the distance of a pair is the owner's weight times how far the other is.
Particles are put into tiles and an owner is joined with the particles of its own
and the neighbouring tiles, which hold everybody within one tile width.  What lies
beyond is at least a width away, so its distance has a lower bound; owners whose
bound may still reach the best step of their event go on with tiles twice as wide,
until a tile is as wide as the reach of a pair.  Small tiles first: a crowded
event does not form all its pairs.

Everything is a DataFrame operation, so one event of any size uses many tasks.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetlake.functions import kinematics as kin
from jetlake.operators.grouping import checked_broadcast, fixed, join_on

COMPONENTS = ("px", "py", "pz", "e")
TINY = 1e-300       # least squared size that enters a weight
BEAM_LAST = 2**31 - 1  # sorts a beam step after the pairs of its particle
FINEST = 12         # halvings of the reach
PER_TILE = 2.0      # particles that a tile should hold at first
_WIDER = 1 + 1e-9   # more than the rounding of a tile's bounds


def _axes(family: str) -> list[str]:
    """Coordinates: rapidity and azimuth, or the direction as a unit vector."""
    return ["y", "phi"] if family == "pp" else ["ux", "uy", "uz"]


def points(events: DataFrame, keys, spec, particles="particles") -> DataFrame:
    """One row per particle: keys, number ``i``, weight ``k`` and coordinates.

    A momentum that is null or not a finite number is an error that names its event.
    """
    rows = events.select(*keys, F.posexplode(particles).alias("i", "q"))
    parts = {c: F.col(f"q.{c}").cast("double") for c in COMPONENTS}
    known = [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in parts.values()]
    event = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in keys])
    bad = F.raise_error(F.concat(F.lit("momentum that is not a number in event: "), event)).cast("double")
    fine = known[0] & known[1] & known[2] & known[3]
    rows = rows.select(*keys, "i", *[F.when(fine, c).otherwise(bad).alias(n) for n, c in parts.items()])
    if spec.scheme != "E":
        rows = rows.withColumn("e", F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2))
    px, py, pz, e = (F.col(c) for c in COMPONENTS)
    if spec.family == "pp":
        size, axes = px * px + py * py, {"y": kin.rapidity(px, py, pz, e), "phi": kin.phi(px, py)}
    else:
        p = F.sqrt(px * px + py * py + pz * pz)
        unit = F.when(p > 0, p).otherwise(F.lit(1.0))
        size, axes = e * e, {"ux": px / unit, "uy": py / unit, "uz": pz / unit}
    weight = F.lit(1.0) if spec.power == 0 else F.pow(F.greatest(size, F.lit(TINY)), F.lit(spec.power))
    return rows.select(*keys, "i", weight.alias("k"), *[c.alias(n) for n, c in axes.items()])


def _apart(family: str, a: str, b: str) -> Column:
    """How far two particles are: squared (y, phi) distance, or 1 - cos(theta)."""
    def at(side, name):
        return F.col(f"{side}{name}")

    if family == "pp":
        turn = F.abs(at(a, "phi") - at(b, "phi"))
        turn = F.least(turn, F.lit(kin.TWO_PI) - turn)
        rise = at(a, "y") - at(b, "y")
        return rise * rise + turn * turn
    return F.lit(1.0) - (at(a, "ux") * at(b, "ux") + at(a, "uy") * at(b, "uy") + at(a, "uz") * at(b, "uz"))


def _scale(spec) -> tuple[float, float]:
    """The factor of a pair's distance, and the reach: the width beyond which no pair comes before the beam."""
    if spec.family == "pp":
        return 1.0 / spec.R**2, spec.R
    if spec.family == "Durham":
        return 2.0, 2.0
    if spec.R < math.pi:
        return 1.0 / (1.0 - math.cos(spec.R)), min(2.0, math.sqrt(2.0 * (1.0 - math.cos(spec.R))))
    return 1.0 / (3.0 + math.cos(spec.R)), 2.0


def _tiles(family: str, width: Column) -> list[Column]:
    """The tile of a particle along each axis; azimuth is divided into whole tiles around the circle."""
    if family == "pp":
        around = F.greatest(F.floor(F.lit(kin.TWO_PI) / width), F.lit(1))
        turn = F.least(F.floor(F.col("phi") / (F.lit(kin.TWO_PI) / around)), around - 1)
        return [F.floor(F.col("y") / width), turn]
    return [F.floor(F.col(c) / width) for c in _axes(family)]


def _neighbours(family: str, width: Column) -> Column:
    """The tiles around a particle's own, each once."""
    steps = [F.array(t - 1, t, t + 1) for t in (F.col(f"t{n}") for n in range(len(_axes(family))))]
    if family == "pp":
        around = F.greatest(F.floor(F.lit(kin.TWO_PI) / width), F.lit(1))
        steps[1] = F.array_distinct(F.transform(steps[1], lambda t: F.pmod(t, around)))

    def with_axis(found, n):
        return F.flatten(F.transform(found, lambda s: F.transform(steps[n], lambda t: F.struct(
            *[s[f"t{m}"].alias(f"t{m}") for m in range(n)], t.alias(f"t{n}")))))

    found = F.transform(steps[0], lambda t: F.struct(t.alias("t0")))
    for n in range(1, len(steps)):
        found = with_axis(found, n)
    return found


def _crowding(spec, reach: float) -> Column:
    """How often the reach is halved at first, so that a tile holds few particles (an aggregate)."""
    if spec.family == "pp":
        ends = F.percentile_approx("y", [0.05, 0.95], 1000)
        room = (F.get(ends, F.lit(1)) - F.get(ends, F.lit(0)) + F.lit(spec.R)) * F.lit(kin.TWO_PI)
    else:
        room = F.lit(4.0 * math.pi)
    width = F.sqrt(F.lit(PER_TILE) * room / F.count("*"))
    return F.least(F.greatest(F.floor(F.log2(F.lit(reach) / width)), F.lit(0)), F.lit(FINEST))


def first_steps(events: DataFrame, spec, keys, particles="particles") -> DataFrame:
    """The first step of each event: keys, ``parent1``, ``parent2`` (-1 beam), ``dij``.

    Of equal distances the least (first, second) wins, the beam coming after all
    partners of a particle.  Keys identify an event; events without particles have
    no step.  With Durham the beam only takes a particle that is alone.
    """
    keys = list(keys)
    factor, reach = _scale(spec)
    axes = _axes(spec.family)
    tile = [f"t{n}" for n in range(len(axes))]
    found = fixed(points(events, keys, spec, particles))
    beam = F.col("k") * F.lit(4.0 if spec.family == "Durham" else 1.0)
    beams = found.groupBy(*keys).agg(
        F.min(F.struct(beam.alias("d"), F.col("i").alias("first"), F.lit(BEAM_LAST).alias("second"))).alias("beam"),
        F.count("*").alias("n"), _crowding(spec, reach).alias("level"))
    alone = F.col("n") == 1 if spec.family == "Durham" else F.lit(True)
    best = fixed(beams.select(*keys, "level", F.when(alone, F.col("beam")).alias("best")))
    owners = join_on(found, checked_broadcast(best), keys).select(*found.columns, "level", "best")

    while True:
        # Everybody of the events that still look, in tiles of the width their event has come to.
        width = F.lit(reach * _WIDER) / F.pow(F.lit(2.0), F.col("level"))
        owners = fixed(owners.withColumns(dict(zip(tile, _tiles(spec.family, width)))))
        seeking = owners.select(*keys, "level").distinct()
        others = join_on(found, checked_broadcast(seeking), keys).withColumns(dict(zip(tile, _tiles(spec.family, width))))
        others = others.select(*keys, *tile, *[F.col(c).alias(f"o_{c}") for c in ("i", "k", *axes)])
        around = owners.withColumn("near", F.explode(_neighbours(spec.family, width))).drop(*tile).select("*", "near.*")
        pairs = join_on(around, others, [*keys, *tile]).where("o_k > k OR (o_k = k AND o_i > i)")
        step = F.struct((F.col("k") * F.lit(factor) * _apart(spec.family, "", "o_")).alias("d"),
                        F.least("i", "o_i").alias("first"), F.greatest("i", "o_i").alias("second"))
        nearest = pairs.groupBy(*keys).agg(F.min(step).alias("pair"))
        best = join_on(best, nearest, keys, "left").select(*keys, "level", F.least("best", "pair").alias("best"))
        # Beyond one width a pair of this owner costs at least this much.
        beyond = width * width / (1.0 if spec.family == "pp" else 2.0)
        bound = F.col("k") * F.lit(factor) * beyond * F.lit(1 - 1e-12)
        best = fixed(best)
        still = owners.where("level > 0").drop("best", "level", *tile)
        owners = join_on(still, checked_broadcast(best), keys).where(F.col("best").isNull() | (bound <= F.col("best.d")))
        owners = owners.withColumn("level", F.col("level") - 1)
        best = best.withColumn("level", F.col("level") - 1)
        if owners.isEmpty():
            break
    return best.select(
        *keys, F.col("best.first").cast("int").alias("parent1"),
        F.when(F.col("best.second") == BEAM_LAST, -1).otherwise(F.col("best.second")).cast("int").alias("parent2"),
        F.col("best.d").alias("dij"))
