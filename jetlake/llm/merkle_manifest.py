"""Merkle manifest of a dataset, with a version of the tree for every tampered leaf.

Each row is a leaf: the sha256 of its fields, each as byte count, ``:`` and value
(``-`` if null).  Per source, leaves ascend by doc_id; while several nodes remain,
every 16 consecutive ones become the digest of their joined digests.  The subroots,
by source, give the root in the same way.

The tree is built in aligned blocks of 256 nodes (two levels).  Leaves are sorted
by range, numbered with the counts of the ranges before them, and grouped by
block; a block's root is a node of the next, 256 times smaller table, and so on
until each source is one node.  Blocks are bounded, whatever share of the rows a
source holds, and nothing but the root reaches the driver.  On the way down every
block learns the siblings of its own root once; its leaves share them.

Trees are persistent.  A tampered leaf makes a version that copies only its
ancestors within the block and keeps all other nodes; the version goes on upwards
with the siblings of the block, so its root costs one digest a level.

Defined results: rows with a null source form a source of their own, the first;
within a source rows without doc_id come first and rows of equal doc_id go by
their leaf.  Rows without doc_id are never tampered.  Empty texts have a count of
0.  A text of any length is one field of its leaf and is not carried further.  An
empty table gives an empty result; columns other than the fields are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from jetlake.llm.common import columns, dropped, small, staged

FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
PATHS = 2_000  # rows of a few KB that a join may broadcast
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "g string, block long, left array<string>, right array<string>, subroot string"
_ARROW_PATH = pa.schema([("g", pa.string()), ("block", pa.int64()), ("left", pa.list_(pa.string())),
                         ("right", pa.list_(pa.string())), ("subroot", pa.string())])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    """Digest of a row's fields."""
    texts = (F.col(f) if isinstance(f, str) else f for f in fields)
    texts = (t.cast("string") for t in texts)
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, copy): g orders the sources, copy is the leaf after tampering."""
    rows = columns(docs, *FIELDS).withColumn("doc_id", F.col("doc_id").cast("long"))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.translate("text", _UPPER, _LOWER)
    return rows.select(
        F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source").cast("string"))).alias("g"),
        "doc_id", leaf(*FIELDS).alias("leaf"), F.when(tampered, leaf(*FIELDS[:-1], lower)).alias("copy"))


def _numbered(batches):
    part, group, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for g in batch.column("g").to_pylist():
            group, at = g, at + 1 if g == group else 0
            places.append(at)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())],
            names=[*batch.schema.names, "part", "place"])


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """Adds pos, the rank within g by ``order`` (nulls first), and n, the rows of g.

    Ranges of the sorted rows are numbered by their tasks; a range starts after the
    counts of the ranges before it.  A large g spans many ranges.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(ranges, "g", *order).sortWithinPartitions("g", *order)
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("place", LongType())])
    local = staged(ranged.mapInArrow(_numbered, schema), "numbered")
    window = Window.partitionBy("g")
    before = window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(local.groupBy("g", "part").agg(F.count("*").alias("c")).select(
        "g", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(window).alias("n")), "starts")
    return local.join(small(starts), ["g", "part"]).withColumn("pos", F.col("place") + F.col("start")).drop(
        "part", "place", "start")


class Tree:
    """The nodes of a block, level by level; never changed, so that versions can share them."""

    def __init__(self, nodes: list[str], alone: bool):
        self.levels = [nodes]
        # A block that is all of its source ends at one node; others rise by whole blocks.
        while len(self.levels[-1]) > 1 or not alone and len(self.levels) <= LEVELS:
            under = self.levels[-1]
            self.levels.append([digest(*under[k:k + FAN]) for k in range(0, len(under), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, place: int) -> tuple[list[str], list[str]]:
        """The joined digests left and right of the path, level by level."""
        left, right = [], []
        for nodes in self.levels[:-1]:
            start = place - place % FAN
            left.append("".join(nodes[start:place]))
            right.append("".join(nodes[place + 1:start + FAN]))
            place //= FAN
        return left, right

    def version(self, place: int, node: str) -> list[str]:
        """The path of a changed leaf, copied up to the block's root; all other nodes are shared."""
        path = [node]
        for nodes in self.levels[:-1]:
            start = place - place % FAN
            path.append(digest(*nodes[start:place], path[-1], *nodes[place + 1:start + FAN]))
            place //= FAN
        return path


def continued(node: str, left: list[str], right: list[str]) -> str:
    """The root of a version whose path goes on above its block."""
    for before, after in zip(left, right):
        node = digest(before, node, after)
    return node


def _rooted(batches):
    for batch in batches:
        alone = batch.column("alone").to_pylist()
        roots = [Tree([e["node"] for e in entries], a).root
                 for entries, a in zip(batch.column("entries").to_pylist(), alone)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "root"])


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """(g, block, blocks, alone, entries, root) of the rows (g, pos, n, node) and carried columns."""
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    entry = F.struct("pos", "node", *carried)
    grouped = nodes.withColumn("block", block).groupBy("g", "block").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), F.max("n").alias("n"))
    grouped = grouped.select("g", "block", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"),
                             (F.col("n") <= BLOCK).alias("alone"), "entries")
    schema = StructType([*grouped.schema.fields, StructField("root", StringType())])
    return staged(grouped.mapInArrow(_rooted, schema), "blocks")


def forest(nodes: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks, each over the roots of the one before, and (g, root) of every group."""
    levels = [blocks(nodes, *carried)]
    while not levels[-1].where("not alone").isEmpty():
        levels.append(blocks(levels[-1].where("not alone").select(
            "g", F.col("block").alias("pos"), F.col("blocks").alias("n"), F.col("root").alias("node"))))
    roots = levels[0].where("alone").select("g", "root")
    for level in levels[1:]:
        roots = roots.union(level.where("alone").select("g", "root"))
    return levels, staged(roots, "subroots")


def _paths(batches):
    """The siblings of each node of a block: its own in the block, then those of the block's root."""
    for batch in batches:
        names = ("g", "alone", "entries", "left", "right", "subroot")
        for g, alone, entries, left, right, subroot in zip(*(batch.column(c).to_pylist() for c in names)):
            tree = Tree([e["node"] for e in entries], alone)
            own = [tree.siblings(place) for place in range(len(entries))]
            # Of the subroots' blocks each node names a source and is its subroot.
            found = {
                "g": [e.get("name", g) for e in entries],
                "block": [0 if "name" in e else e["pos"] for e in entries],
                "left": [x + left for x, _ in own], "right": [y + right for _, y in own],
                "subroot": [e["node"] if "name" in e else subroot for e in entries]}
            yield pa.RecordBatch.from_pydict(found, schema=_ARROW_PATH)


def with_paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest blocks, each with the siblings of its root up to the top and its source's subroot.

    ``top`` has one row per group: its path above.  Blocks that are all of their
    group take it, others the path that the table of blocks above found for them.
    """
    found = None
    for depth in range(len(levels) - 1, -1, -1):
        alone = levels[depth].where("alone").select("g")
        paths = top.join(alone, "g", "left_semi")
        if found is not None:
            paths = paths.unionByName(found)
        joined = levels[depth].join(small(paths, PATHS), ["g", "block"])
        if depth:
            found = staged(joined.mapInArrow(_paths, _PATH), "paths")
    return joined


def _checked(batches):
    for batch in batches:
        names = ("alone", "entries", "left", "right", "root", "subroot")
        for alone, entries, left, right, own, subroot in zip(*(batch.column(c).to_pylist() for c in names)):
            tree = Tree([e["node"] for e in entries], alone)
            above = "".join(x + y for x, y in zip(left, right))
            same = continued(own, left, right)  # the version without a change
            proofs, folded = [], []
            for place, e in enumerate(entries):
                x, y = tree.siblings(place)
                proofs.append(digest(*(a + b for a, b in zip(x, y)), above))
                folded.append(same if e["copy"] in (None, e["node"])
                              else continued(tree.version(place, e["copy"])[-1], left, right))
            yield pa.RecordBatch.from_arrays(
                [pa.array([e["doc_id"] for e in entries], pa.int64()), pa.array([e["node"] for e in entries], pa.string()),
                 pa.array([subroot] * len(entries), pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
                names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    made = staged(leaves(docs), "leaves")
    levels, subroots = forest(positions(made, "doc_id", "leaf").withColumnRenamed("leaf", "node"), "doc_id", "copy")
    # Above the sources: one group of all subroots, in the order of g.
    named = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("node"))
    tops, roots = forest(positions(named, "name"), "name")
    found = roots.collect()  # one row
    root = F.lit(found[0].root if found else None).cast("string")
    nothing = F.array().cast("array<string>")
    start = roots.select("g", F.lit(0).cast("long").alias("block"), nothing.alias("left"), nothing.alias("right"),
                         F.lit(None).cast("string").alias("subroot"))
    sources = staged(with_paths(tops, start).mapInArrow(_paths, _PATH), "sources")
    rows = with_paths(levels, sources).mapInArrow(
        _checked, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    dropped(made)
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                       (F.col("folded_root") == root).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
