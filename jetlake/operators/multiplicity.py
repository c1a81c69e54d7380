"""Event multiplicity: per event, per file, and as histograms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetlake.constants import CHARGED_ELEMENTARY
from jetlake.operators.events import FINAL_STATE


def multiplicity(events: DataFrame, keys=("file",)) -> DataFrame:
    """Number of events and mean particle count of each file, by rising mean."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.avg(F.size("particles")).alias("mean_particles")
    ).orderBy("mean_particles", *keys)


def event_counts(particles: DataFrame, keys=("event",), charged=False) -> DataFrame:
    """Final-state particles per event from particle rows, counted before the shuffle.

    Events without any such particle count 0.
    """
    wanted = F.col("status") == FINAL_STATE
    if charged:
        wanted = wanted & is_charged(F.col("pdgid"))
    return particles.groupBy(*keys).agg(F.count_if(wanted).alias("n_particles"))


def is_charged(pdgid):
    """Whether a particle number stands for a charged particle, by its digits.

    Nuclei are 10LZZZAAAI.  Hadrons name their quarks by three digits in front of
    the last one; quarks 2, 4 and 6 have the upper charge.  A meson (first digit
    0) is charged if its quarks differ in that, a baryon unless exactly one of
    its three has the upper charge.
    """
    code = F.abs(pdgid).cast("long")
    digit = lambda place: F.floor(code / place) % 10
    upper = lambda place: digit(place).isin(2, 4, 6).cast("int")
    nucleus = F.floor(code / 10_000) % 1000 > 0
    baryon = upper(10) + upper(100) + upper(1000) != 1
    meson = upper(10) != upper(100)
    return (F.when(code >= 1_000_000_000, nucleus).when(code <= 100, code.isin(*CHARGED_ELEMENTARY))
            .when(digit(1000) > 0, baryon).otherwise(meson))


def charged_counts(events: DataFrame) -> DataFrame:
    """Charged final-state particles of event rows, as ``n_particles``."""
    chosen = F.filter("particles", lambda p: (p["status"] == FINAL_STATE) & is_charged(p["pdgid"]))
    return events.withColumn("n_particles", F.size(chosen)).drop("particles")


def fixed_histogram(counts: DataFrame, column="n_particles", low=-0.5, high=799.5, bins=100, keys=()) -> DataFrame:
    """Counts per bin; bin 0 lies below the range and bin ``bins + 1`` above."""
    number = F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).cast("int")
    width = (high - low) / bins
    return (counts.groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("count"))
            .withColumn("low", F.lit(low) + (F.col("bin") - 1) * F.lit(width)))


def manifest_rows(events: DataFrame) -> DataFrame:
    """The ``File,mean_particles`` lines of a manifest."""
    return multiplicity(events).select(
        F.element_at(F.split("file", "/"), -1).alias("File"), "mean_particles")
