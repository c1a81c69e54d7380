"""Exact deduplication by a stateful stream.

Documents are equal when their texts are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted.  A stream of digest rows runs through keyed
state on disk (RocksDB, no expiry).  For each SHA-256 digest the state retains
the row that stays: its length, its stable identifier and its content locator
(file and row index), and the size of the group.  Partial aggregation in front
of the state means that a hot digest sends one row per task.

The state alone trusts the digest.  Each hit is therefore checked on the full
bytes: the located rows of every group with several members are read again and
compared (least text = greatest text, also with partial aggregation).  Groups
whose digest stands for different texts are divided by the text itself.

Defined results: null texts count as empty and empty texts equal each other;
rows without doc_id are grouped too and lose ties against rows with one;
repeated rows (same id, same text) keep exactly one, the first by locator; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jetlake.llm.common import columns, free_name, has_file_position, new_folder, small, staged
from jetlake.llm.common import settings as _settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DIGESTS = "doc_id long, chars int, digest binary, file string, row long"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def digest_rows(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One narrow row per document: id, length, digest and locator.  No shuffle."""
    digest = F.unhex(F.sha2(normalized(F.col("text")), 256))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("chars"),
        F.substring(digest, 1, digest_bytes).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def update_state(spark: SparkSession, arrivals: str, state: str, files_per_trigger: int = 4096) -> None:
    """Feed the digest files of the folder ``arrivals`` that the state at ``state`` has not seen yet."""
    rows = (spark.readStream.schema(DIGESTS).option("maxFilesPerTrigger", files_per_trigger).parquet(arrivals))
    best = F.max(F.struct("chars", (-F.col("doc_id")).alias("id"), (-F.col("row")).alias("row"), "file"))
    retained = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
    with _settings(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                             "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
                             # the stores of an executor share so much, and none stays open when its task is done
                             "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
                             "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
                             "spark.sql.streaming.stateStore.unloadOnCommit": "true",
                             # no space is set aside in advance: many partitions then cost no more than their keys
                             "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}):
        query = (retained.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", state).start())
        query.awaitTermination()


def retained_groups(spark: SparkSession, state: str) -> DataFrame:
    """The keyed state: digest, the row that stays and the group's size."""
    table = spark.read.format("statestore").load(state)
    best, count = table.schema["value"].dataType.names[:2]
    value = F.col("value")
    return table.select(
        F.col("key.digest").alias("digest"),
        (-value[best]["id"]).alias("keep_id"), value[best]["file"].alias("keep_file"),
        (-value[best]["row"]).alias("keep_row"), value[count].alias("group_size"))


def _divided(docs: DataFrame, members: DataFrame, collided: DataFrame) -> DataFrame:
    """Groups by whole text for the rows whose digest stands for several texts."""
    rows = (members.join(collided, "digest", "left_semi")
            .join(docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
                              normalized(F.col("text")).alias("norm")), ["file", "row"]))
    best = F.max(F.struct("chars", (-F.col("doc_id")).alias("id"), (-F.col("row")).alias("row"), "file"))
    groups = rows.groupBy("norm").agg(best.alias("best"), F.count("*").alias("group_size"))
    return (rows.select("file", "row", "norm").join(groups, "norm")
            .select("file", "row", (-F.col("best.id")).alias("d_id"), F.col("best.file").alias("d_file"),
                    (-F.col("best.row")).alias("d_row"), F.col("group_size").alias("d_size")))


def deduplicate(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """Every row of ``docs`` with doc_id, keep_id, group_size, kept, digest (binary), file, row.

    ``digest_bytes`` below 32 shortens the retained digest; results stay the same.
    """
    spark = docs.sparkSession
    docs = columns(docs, "doc_id", "text") if has_file_position(docs) else staged(columns(docs, "doc_id", "text"), "texts")
    arrivals, state = new_folder(spark, "arrivals"), new_folder(spark, "state")
    digest_rows(docs, digest_bytes).write.parquet(arrivals)
    digests = spark.read.schema(DIGESTS).parquet(arrivals)
    update_state(spark, arrivals, state)
    groups = staged(retained_groups(spark, state), "groups")

    members = staged(digests.join(groups.where("group_size > 1").select("digest"), "digest"), "members")
    located = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "text")
    hits = located.join(small(members.select("file", "row", "digest")), ["file", "row"])
    collided = staged(hits.groupBy("digest")
                      .agg(F.min(normalized(F.col("text"))).alias("lo"), F.max(normalized(F.col("text"))).alias("hi"))
                      .where("lo <> hi").select("digest"), "collided")
    result = digests.join(groups, "digest", "left")
    if not collided.isEmpty():
        result = result.join(_divided(docs, members, collided), ["file", "row"], "left")
        for name, other in (("keep_id", "d_id"), ("keep_file", "d_file"), ("keep_row", "d_row"), ("group_size", "d_size")):
            result = result.withColumn(
                name, F.when(F.col("d_size").isNull(), F.col(name)).otherwise(F.col(other)))
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return result.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "file", "row")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, all columns as they came."""
    names = docs.columns
    docs = docs if has_file_position(docs) else staged(docs, "texts")
    file, row = free_name(docs, "kept_file"), free_name(docs, "kept_row")
    stays = deduplicate(docs).where("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    located = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return located.join(small(staged(stays, "kept")), [file, row], "left_semi").select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
