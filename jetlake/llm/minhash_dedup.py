"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct 5-word shingles.  Each of 160
permutations keeps both its least and its greatest value, so 320 signature
values cost 160 hash evaluations.  Four permutations (eight values) make a
band; two sets of similarity s share one of the 40 bands with probability
1 - (1 - s^8)^40, which is 0.999997 at 0.85 and 0.0026 at 0.3.

Equal sets form one class first.  The classes of a band are then compared
with pivots, not with each other: every round confirms all other members of a
band against its pivots on the full sets, and the pivots leave the band.  A
band is finished when its members are in one component; otherwise the next
round takes four times as many pivots.  In the end every pair that shares a
band is either confirmed, refuted or already connected: no connection is lost
and no group emits all its pairs.

Defined results: a document without words has no shingles and is its own
component; so is a row without doc_id (component NULL, kept).  Rows that repeat
an id share its component.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jetlake.llm.common import columns, free_name, long_list, mixed, shingle_set, slices, small, staged, texts_of
from jetlake.llm.components import components

PERMUTATIONS, BAND = 160, 4
_SIGNATURE = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def _permutations(count: int):
    """Odd multipliers and offsets of the permutations x -> a x + b of 32-bit values."""
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return (seeds[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[count:] >> np.uint64(32)).astype(np.uint32)


def min_max_signature(shingles: np.ndarray, permutations: int = PERMUTATIONS, block: int = 4096) -> np.ndarray:
    """Least and greatest value under each permutation: array (permutations, 2)."""
    a, b = _permutations(permutations)
    low = np.full(permutations, np.iinfo(np.uint32).max, np.uint32)
    high = np.zeros(permutations, np.uint32)
    points = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(points), block):
        values = np.multiply.outer(a, points[start:start + block])
        values += b[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1)


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key per band of ``band`` permutations; the band's number is part of it."""
    rows = mixed(signature.reshape(len(signature) // band, 2 * band).astype(np.uint64))
    weights = mixed(np.arange(101, 101 + 2 * band, dtype=np.uint64)) | np.uint64(1)
    number = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed((rows * weights).sum(axis=1, dtype=np.uint64) + number)


def _signatures(batches, permutations, band):
    for batch in slices(batches):
        sizes, keys, bands, offsets = [], [], [], [0]
        for text in texts_of(batch):
            shingles = shingle_set(text)
            digest = xxhash.xxh3_128(shingles.tobytes()).intdigest()
            sizes.append(len(shingles))
            keys.append(((digest >> 64) - 2**63, digest % 2**64 - 2**63))
            if len(shingles):
                bands.append(band_keys(min_max_signature(shingles, permutations), band))
            offsets.append(offsets[-1] + (len(bands[-1]) if len(shingles) else 0))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(sizes, pa.int64()),
            pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
            long_list(offsets, np.concatenate(bands) if bands else np.array([], np.uint64))],
            names=["doc_id", "n_shingles", "k1", "k2", "bands"])


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _signatures(batches, permutations, band), _SIGNATURE)


def _sets(batches):
    for batch in slices(batches):
        offsets, found = [0], [np.array([], np.uint64)]
        for text in texts_of(batch):
            found.append(shingle_set(text))
            offsets.append(offsets[-1] + len(found[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), long_list(offsets, np.concatenate(found))], names=["id", "shingles"])


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full shingle sets."""
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(ids), "id", "left_semi")
    # An id with several texts counts with the least of its sets.
    sets = staged(texts.mapInArrow(_sets, "id long, shingles array<long>").groupBy("id")
                  .agg(F.min("shingles").alias("shingles")), "sets")
    rows = (pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a"))
    both = rows.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                       F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"))
    return both.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def _own_shingles(batches):
    """(shingle, rows, owner): shingles counted within a piece of the input before they are exchanged."""
    for batch in slices(batches, 4096):
        ids = batch.column("id").to_numpy()
        found = [shingle_set(text) for text in texts_of(batch)]
        joined = np.concatenate(found) if found else np.array([], np.uint64)
        owners = np.repeat(ids, [len(f) for f in found])
        values, first, counts = np.unique(joined, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(counts, pa.int64()), pa.array(owners[first], pa.int64())],
            names=["shingle", "rows", "owner"])


def private_sizes(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own): how many shingles of a class occur in no other class of ``ids``."""
    texts = (docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(ids), "id", "left_semi")
             .groupBy("id").agg(F.min("text").alias("text")))
    counted = texts.mapInArrow(_own_shingles, "shingle long, rows long, owner long")
    single = counted.groupBy("shingle").agg(F.sum("rows").alias("rows"), F.min("owner").alias("owner")).where("rows = 1")
    return single.groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("own"))


def bitset(shingles: np.ndarray) -> np.ndarray:
    """Which of a power of two of buckets (at least four for each shingle, within 256 to 16,384) are taken, as 64-bit words."""
    size = 1 << min(max(int(4 * len(shingles) - 1).bit_length(), 8), 14)
    taken = np.zeros(size, np.uint8)
    taken[shingles & np.uint64(size - 1)] = 1
    return np.packbits(taken, bitorder="little").view(np.uint64)


def _bitsets(batches):
    for batch in slices(batches):
        offsets, found = [0], [np.array([], np.uint64)]
        for text in texts_of(batch):
            found.append(bitset(shingle_set(text)))
            offsets.append(offsets[-1] + len(found[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), long_list(offsets, np.concatenate(found))], names=["id", "bits"])


def bitsets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, bits) of the classes; an id with several texts has none."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(ids), "id", "left_semi")
    found = texts.mapInArrow(_bitsets, "id long, bits array<long>")
    return found.groupBy("id").agg(F.min("bits").alias("bits"), F.max("bits").alias("other")).where("bits = other").drop("other")


def _lacking(one: str, other: str):
    """At least so many shingles of ``one`` are not in ``other``: each bucket that only ``one`` takes holds such a shingle."""
    def folded(name, against):
        bits, half = F.col(name), F.expr(f"size({name}) div 2")
        halves = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseOR(y))
        return F.when(F.size(bits) > F.size(against), halves).otherwise(bits)

    only = F.zip_with(folded(one, other), folded(other, one), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.coalesce(F.aggregate(only, F.lit(0), lambda total, count: total + count), F.lit(0))


def _candidates(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (pivot, member) of a band that the sizes allow: no more than ``s`` shingles can be common.

    Pivots that know the bands they ``led`` meet a member in the first of its ``open`` bands only,
    and only if the buckets of both sets allow enough common shingles.
    """
    condition = f"p <> id and pl <> label and 100 * least(s, ps, n, pn) >= {percent} * (n + pn - least(s, ps, n, pn))"
    led = ["led", F.col("bits").alias("pbits")] if "led" in pivots.columns else []
    pivots = pivots.select("band", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("s").alias("ps"),
                           F.col("label").alias("pl"), *led)
    allowed = F.expr(condition)
    if led:
        common = F.least(F.col("n") - _lacking("bits", "pbits"), F.col("pn") - _lacking("pbits", "bits"))
        allowed &= F.expr("array_min(array_intersect(led, open)) = band")
        allowed &= (100 + percent) * common >= percent * (F.col("n") + F.col("pn"))
    pairs = members.join(pivots, "band").where(allowed)
    return pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their labels, of the bands that still hold several components."""
    members = members.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return members.join(several.select("band"), "band", "left_semi")


def linked_classes(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, label) of the classes that have a link; classes: id, n, bands.

    The first pivot of a band is the member that shares most bands with others,
    the likely origin of a group of copies.  Later pivots come in blocks, members
    without links first.  Before them, shingles that no other open member has
    bound what a member can have in common with any other, and the buckets that
    its shingles take what two members can have in common.  From then on a pair
    is made once, not in every band it shares: a band of ``open`` that a member
    has left since is one where it was a pivot and met all others.
    """
    buckets = classes.select(F.explode("bands").alias("band"), "id", "n", F.col("n").alias("s"), F.col("id").alias("label"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = staged(buckets.join(shared, "band"), "members")
    degree = members.groupBy("id").agg(F.sum("members").alias("degree"))
    ranked = members.drop("members").join(degree, "id")
    first = staged(ranked.groupBy("band").agg(
        F.max(F.struct("degree", (-F.col("id")).alias("neg"), "n")).alias("m"))
        .select("band", (-F.col("m.neg")).alias("id"), F.col("m.n").alias("n"), F.col("m.n").alias("s"),
                (-F.col("m.neg")).alias("label")), "pivots")
    members, pivots, links, block = members.drop("members"), first, None, 1
    bands_of = Window.partitionBy("id")
    while True:
        pairs = staged(_candidates(members, pivots, percent), "pairs")
        found = staged(confirmed(docs, pairs, percent), "links")
        links = found if links is None else links.union(found)
        labels = components(links)
        left = members.join(pivots.select("band", "id"), ["band", "id"], "left_anti")
        members = staged(_unresolved(left, labels), "members")
        if members.isEmpty():
            return labels
        if block == 1:
            ids = staged(members.select("id").distinct(), "ids")
            own = private_sizes(docs, ids)
            members = staged(members.drop("s").join(own, "id", "left").join(bitsets(docs, ids), "id", "left")
                             .withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
                             .withColumn("open", F.collect_list("band").over(bands_of)), "members")
        block *= 8
        order = F.row_number().over(Window.partitionBy("band").orderBy(F.col("label") != F.col("id"), "id"))
        pivots = staged(members.drop("open").withColumn("rank", order).where(F.col("rank") <= block).drop("rank")
                        .withColumn("led", F.collect_list("band").over(bands_of)), "pivots")


def near_duplicates(docs: DataFrame, percent: int = 85, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = columns(docs, "doc_id", "text")
    signed = staged(signatures(docs, permutations, band), "signatures")
    key = ["k1", "k2", "n_shingles"]
    classes = staged(signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key)
                     .agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    labels = linked_classes(docs, classes.select("id", F.col("n_shingles").alias("n"), "bands"), percent)
    named = classes.drop("bands").join(labels, "id", "left").select(*key, F.coalesce("label", "id").alias("component"))
    rows = signed.drop("bands").join(named, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The first document of each group of near duplicates, and all others; columns as they came.

    At 80 % three permutations make a band: 53 bands miss a pair with probability 1e-7.
    """
    name = free_name(docs, "gone_id")
    gone = staged(near_duplicates(docs, percent, permutations=159, band=3).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(small(gone), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
