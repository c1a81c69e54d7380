"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is the set of its distinct 5-word shingles and is contained in a
document if at least 80 % of them occur there.  A short item in a long document
has almost no Jaccard similarity with it, so the search is partitioned by size:
items of up to h shingles (h = 16, 32, 64, ...) are compared with windows of 2 h
shingles taken every h, of which one holds any passage of h.  There the
similarity is at least 0.19, and one equal value among 64 minimum hashes makes
the document a candidate (missed with probability below 1.4e-6).  Window minima
of a size come from those of the half size.  Items of up to eight shingles are
looked up by all their shingles.  Every candidate is verified by the exact
share of the item's shingles in the whole document, in the same task: documents
are never shuffled.

The benchmark is a stated query set, indexed in blocks of at most ``BLOCK_CHARS``
characters on average; each block is one pass over all documents.

Defined results: empty and null texts contain nothing and are contained in
nothing; an item of fewer than five words is one shingle, found only where the
whole document is the same words; repeated rows give one pair; rows without id
on either side are left out; only ids and texts are read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetlake.llm.common import free_name, mixed, shingle_hashes, shingle_set, slices, small, staged, texts_of, word_hashes

HASHES, LEAST, PERCENT = 64, 16, 80
BLOCK_CHARS = 16_000_000
FILTER_BITS = 20
_PAIR = "doc_id long, item_id long, item_shingles long, common long"

_SEEDS = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_A = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def _hashed(shingles: np.ndarray) -> np.ndarray:
    """(HASHES, n) values of the 32 upper bits under each permutation."""
    values = np.multiply.outer(_A, (shingles >> np.uint64(32)).astype(np.uint32))
    values += _B[:, None]
    return values


def _keyed(minima: np.ndarray) -> np.ndarray:
    return (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))[:, None] | minima.astype(np.uint64)


class Index:
    """The items of one block by size: sorted keys with the items they belong to."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.sets = [], []
        sizes: dict[int, tuple[list, list]] = {}
        for item, text in items:
            shingles = shingle_set(text)
            if not len(shingles):
                continue
            number = len(self.ids)
            self.ids.append(item)
            self.sets.append(shingles)
            size = 0 if len(shingles) <= LEAST // 2 else LEAST
            while size and size < len(shingles):
                size *= 2
            keys = shingles if size == 0 else _keyed(_hashed(shingles).min(axis=1)[:, None])[:, 0]
            held = sizes.setdefault(size, ([], []))
            held[0].append(keys)
            held[1].append(np.full(len(keys), number))
        self.sizes = {}
        for size, (keys, owners) in sizes.items():
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[self._place(keys)] = True
            self.sizes[size] = keys[order], owners[order], seen
        self.largest = max(self.sizes, default=0)

    @staticmethod
    def _place(keys):
        return ((keys ^ (keys >> np.uint64(32))) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def _owners(self, size, keys) -> set[int]:
        table, owners, seen = self.sizes[size]
        keys = np.unique(keys[seen[self._place(keys)]])
        low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
        return {int(owner) for a, b in zip(low, high) if b > a for owner in owners[a:b]}

    def candidates(self, shingles: np.ndarray, block: int = 1 << 15) -> set[int]:
        """Items that share a minimum with a window of these shingles in order."""
        found = self._owners(0, shingles) if 0 in self.sizes else set()
        if not self.largest:
            return found
        halves = []
        for start in range(0, len(shingles), block):  # a multiple of LEAST
            values = _hashed(shingles[start:start + block])
            halves.append(np.minimum.reduceat(values, np.arange(0, values.shape[1], LEAST), axis=1))
        minima, size = np.concatenate(halves, axis=1), LEAST
        while True:
            if size in self.sizes:
                windows = minima if minima.shape[1] == 1 else np.minimum(minima[:, 1:], minima[:, :-1])
                found |= self._owners(size, _keyed(windows).ravel())
            if size >= self.largest:
                return found
            if minima.shape[1] > 1:
                minima = np.minimum.reduceat(minima, np.arange(0, minima.shape[1], 2), axis=1)
            size *= 2


def _search(batches, index: Index, percent: int):
    for batch in slices(batches):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            shingles = shingle_hashes(word_hashes(text))
            found = index.candidates(shingles) if len(shingles) else ()
            whole = np.unique(shingles) if found else shingles
            for number in found:
                item = index.sets[number]
                at = np.minimum(np.searchsorted(whole, item), len(whole) - 1)
                common = int((whole[at] == item).sum())
                if 100 * common >= percent * len(item):
                    rows.append((doc, index.ids[number], len(item), common))
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         names=["doc_id", "item_id", "item_shingles", "common"])


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT,
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, item_shingles, common) of every item contained in a document."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, ceil(chars / block_chars))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = items.where(F.col("block") == block).select("item_id", "text").distinct().collect()
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows]))
        pairs = docs.mapInArrow(lambda batches, index=index: _search(batches, index.value, percent), _PAIR)
        found = pairs if found is None else found.unionAll(pairs)
    return found.distinct()


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that contain no item; columns as they came, rows without id stay."""
    name = free_name(docs, "leak_id")
    leaks = staged(contained_items(docs, benchmark, percent).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(small(leaks), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
