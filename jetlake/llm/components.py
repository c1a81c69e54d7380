"""Connected components of a link table, by the least label among neighbours with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetlake.llm.common import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id of the links (a, b); label is the smallest id reachable.

    Each round takes the least label around an id and then that label's own
    label, so long chains close in a logarithmic number of rounds.  Nothing is
    collected; a hub's rows are combined before they are exchanged.
    """
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    edges = staged(both.select("e.a", "e.b").distinct(), "edges")
    labels = staged(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
                    .select(F.col("a").alias("id"), "label"), "labels")
    while True:
        around = (edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("near")))
        lower = (labels.join(around, labels.id == around.a)
                 .select("id", F.least("label", "near").alias("label"), F.col("label").alias("before")))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = staged(lower.join(jump, "label", "left")
                       .select("id", F.least("label", "further").alias("label"), "before"), "labels")
        changed = not after.where("label < before").isEmpty()
        dropped(labels)
        labels = after.select("id", "label")
        if not changed:
            dropped(edges)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of ``components`` after further links (a, b): only the labels that these join are labelled anew."""
    of = lambda name: labels.select(F.col("id").alias(name), F.col("label").alias(f"of_{name}"))
    ends = staged(links.distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
                  .select(*[F.struct(F.col(name).alias("id"), F.coalesce(f"of_{name}", name).alias("label")).alias(name) for name in "ab"]), "ends")
    top = components(ends.select(F.col("a.label").alias("a"), F.col("b.label").alias("b")).distinct())
    known = labels.unionAll(ends.select(F.explode(F.array("a", "b")).alias("x")).select("x.id", "x.label")).distinct()
    found = staged(known.join(top.select(F.col("id").alias("label"), F.col("label").alias("least")), "label", "left")
                   .select("id", F.coalesce("least", "label").alias("label")), "labels")
    dropped(ends, top)
    return found
