"""Helpers shared by the text operators: staged tables, word shingles, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BROADCAST_ROWS = 1_000_000  # narrow rows; above that the join shuffles

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only under a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="staged-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is staged: its shuffle files go when it is written, and Python tasks get texts in small pieces.
STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
           "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def settings(spark: SparkSession, **values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table of the shared folder and read it back: computed once, lineage cut, shuffle files gone."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with settings(spark, **STAGING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow staged table for broadcast if it was counted and is small; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def bounded_texts(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` distinct texts with the least hashes; only hashes are sorted, texts stay spread."""
    hashed = df.withColumn("__o", F.xxhash64("text"))
    last = hashed.select("__o").distinct().orderBy("__o").limit(rows).agg(F.max("__o")).first()[0]
    return hashed.where(F.col("__o") <= F.lit(last).cast("long")).dropDuplicates(["__o"]).drop("__o")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: any others, whatever their names, stay out of the plan."""
    return df.select(*names)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {column.lower() for column in df.columns}
    while name in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch, null as empty."""
    return [text or "" for text in batch.column(name).to_pylist()]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes (xxh64) of the words of the text."""
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def joined_word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of many texts at once, joined, and how many words each text has."""
    parts = [text.encode("utf-8", "surrogatepass").lower() for text in texts]
    data = b" ".join([b"", *parts, b" " * 8])  # a blank before each text, and room to read 8 bytes at any place
    signs = np.frombuffer(data, np.uint8)
    blank = (signs == 32) | (signs - np.uint8(9) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(part) + 1 for part in parts])
    counts = np.diff(np.searchsorted(starts, ends, "right"), prepend=0)
    return _xxh64(data, signs, starts, sizes), counts


def _xxh64(data: bytes, signs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxh64 of the stretches of ``data``; each of its steps is taken by all stretches at once, longer ones go one by one."""
    one, two, three, four, five = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    eight = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    found = sizes.astype(np.uint64) + five
    short = sizes < 32
    for step in range(3):
        at = np.flatnonzero(short & (sizes >= 8 * step + 8))
        found[at] = turned(found[at] ^ turned(eight[starts[at] + 8 * step] * two, 31) * one, 27) * one + four
    at = np.flatnonzero(short & (sizes & 4 > 0))
    low = eight[starts[at] + (sizes[at] & ~7)] & np.uint64(0xFFFFFFFF)
    found[at] = turned(found[at] ^ low * one, 23) * two + three
    for step in range(3):
        at = np.flatnonzero(short & (sizes & 3 > step))
        found[at] = turned(found[at] ^ signs[starts[at] + (sizes[at] & ~3) + step] * five, 11) * one
    found = (found ^ (found >> np.uint64(33))) * two
    found = (found ^ (found >> np.uint64(29))) * three
    found ^= found >> np.uint64(32)
    for k in np.flatnonzero(~short).tolist():
        found[k] = xxhash.xxh64_intdigest(data[starts[k]:starts[k] + sizes[k]])
    return found


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One hash for each run of five words, in order; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    total = np.full(count, np.uint64(width))
    for k in range(width):
        total += words[k:k + count] * _MULTIPLIERS[k]
    return mixed(total)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text)))


def long_list(offsets: list[int], values: np.ndarray) -> pa.Array:
    """Arrow list of 64-bit integers from row offsets and the joined values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def slices(batches, rows: int = 512):
    """Small pieces of the incoming batches, so that memory follows a few texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def has_file_position(df: DataFrame) -> bool:
    """Whether each row can be located as (file, row index)."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema
        return True
    except Exception as error:  # the analyser's class differs between classic and remote sessions
        if "UNRESOLVED" in str(error) or "FIELD_NOT_FOUND" in str(error):
            return False
        raise
