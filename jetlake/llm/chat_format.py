"""Chat formatting with typed content parts.

A turn holds parts: text, image, audio or document.  A visitor flattens the
parts in order: text is escaped, any other part becomes a placeholder, its
reference goes into a list of attachments and its size into an expanded token
count.  The template of a turn is

    <turn ROLE>\\n BODY </turn>\\n

with ``\\``, ``<`` and ``>`` of roles, texts and references preceded by ``\\``, so
control strings inside a text can always be told from the template's own and
read back.  Only assistant turns are under the loss mask, which covers their
body and nothing else.

A conversation is the concatenation of its segments in order (turn, role,
segment).  Segments stay separate rows: a conversation of any size is formatted
by many tasks, and a reader streams over its sorted segments in constant memory.

Defined results: null texts and roles count as empty, parts of unknown type
become placeholders of that type, null parts vanish; null turns come first;
repeated rows stay; rows without conv_id form one conversation; an empty table
gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jetlake.llm.common import slices

#: Tokens that one unit of a part stands for: image tiles, seconds of audio, document pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 1024}
PART = "array<struct<type:string,text:string,ref:string,units:long>>"

_HEADER = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLACEHOLDER = re.compile(r"(?<!\\)(?:\\\\)*<part ")
END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<>])", r"\\$1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def part_tokens(part: Column) -> Column:
    """Tokens that a part expands to; text is left to the tokenizer."""
    each = F.lit(1)
    for kind, tokens in UNIT_TOKENS.items():
        each = F.when(part["type"] == kind, tokens).otherwise(each)
    return F.when(is_text(part), 0).otherwise(F.coalesce(part["units"], F.lit(1)) * each).cast("long")


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def rendered(part: Column) -> Column:
    placeholder = F.concat(F.lit("<part "), escaped(part["type"]), F.lit(" "), part_tokens(part).cast("string"),
                           F.lit(" "), escaped(part["ref"]), F.lit(">"))
    return F.when(is_text(part), escaped(part["text"])).otherwise(placeholder)


def format_turns(turns: DataFrame) -> DataFrame:
    """Segments of (conv_id, turn, role, parts): segment, loss_start, loss_end, attachments, part_tokens."""
    parts = F.filter(F.coalesce("parts", F.array().cast(PART)), lambda p: p.isNotNull())
    others = F.filter(F.transform("parts", lambda p, i: F.struct(
        i.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"),
        is_text(p).alias("text"))), lambda p: ~p["text"])
    rows = (turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
            .withColumn("head", F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">\n")))
            .withColumn("body", F.array_join(F.transform("parts", rendered), "")))
    masked = F.col("role") == "assistant"
    start = F.char_length("head")
    return rows.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(END)).alias("segment"),
        F.when(masked, start).alias("loss_start"), F.when(masked, start + F.char_length("body")).alias("loss_end"),
        others.alias("attachments"),
        F.aggregate(others, F.lit(0).cast("long"), lambda total, p: total + p["tokens"]).alias("part_tokens"))


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment; placeholders count as no text."""
    head = _HEADER.match(segment)
    if head is None or not segment.endswith(END):
        raise ValueError(f"not a turn: {segment[:60]!r}")
    body = segment[head.end():-len(END)]
    if _PLACEHOLDER.search(body):
        body = re.sub(r"(?s)((?:\\.|[^\\<])*)(?:<(?:\\.|[^\\>])*>)?", r"\1", body)
    return unescaped(head[1]), unescaped(body)


def _digests(batches):
    """One row per conversation from its sorted segments; holds one digest state, never a conversation."""
    out, current, state = [], None, None

    def closed():
        return (current[0], state["n"], state["turns"].hexdigest(), state["loss_chars"],
                state["loss"].hexdigest(), state["chars"])

    def batch_of(rows):
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in slices(batches, 2048):
        for conv, segment, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_end"))):
            if current is None or current[0] != conv:
                if current is not None:
                    out.append(closed())
                current = (conv,)
                state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            role, text = read_segment(segment)
            state["n"] += 1
            state["chars"] += len(segment)
            state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if start is not None:
                learned = unescaped(segment[start:end])
                state["loss_chars"] += len(learned)
                state["loss"].update(learned.encode("utf-8", "surrogatepass"))
        yield batch_of(out)
        out = []
    if current is not None:
        yield batch_of([closed()])


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations say, from the segments alone.

    The digest of a conversation is sequential, so its segments meet in one
    task; they are streamed there, not held.
    """
    ordered = (segments.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment"))
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                        "loss_sha256 string, formatted_chars long")


def text_turns(conversations: DataFrame) -> DataFrame:
    """Plain text rows as turns of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", F.array(part).alias("parts"))


#: Two turns that hold template markers of several kinds.
PROBE = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    return read_back(format_turns(text_turns(rows.unionByName(probe))))
