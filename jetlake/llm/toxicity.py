"""Toxicity from class-conditional Kneser-Ney models of the characters of words.

Words are runs of letters, lower-cased.  Each letter, and the end of a word, is
predicted from up to five letters before it in the same word.  The toxic and the
ordinary model keep their own counts of the longest history; both back off to
the same distribution, made of continuation counts (how many histories a
successor has been seen after) over all training rows.  Because it is shared,
the backoff cancels wherever neither class has seen an expression: a rare word
is evidence only as far as its beginnings are.

  P_c(x | h) = max(n_c(h x) - D, 0) / n_c(h) + D * types_c(h) / n_c(h) * B(x | h')

A word's score is its log-likelihood ratio.  A document's score is the sum of
the ratios beyond ``DEAD_ZONE``, normalised by length, and turned into a
probability by a logistic curve.  The counts come from all training rows, those
whose remainder is not 0.  The curve comes from at most ``CURVE_ROWS`` rows of
remainder 1, read with a model from which all training rows of the same texts
have been subtracted; rows of remainder 0 teach nothing.

Counts are kept by full 64-bit hashes of the grams.  The model that is broadcast
has one entry of 12 bytes per distinct gram and per distinct history, so it
grows with the vocabulary of the training rows.

Defined results: empty and null texts have no evidence and get the curve's
value at zero; labels that are null or without a document teach nothing; rows
without doc_id are scored and not held out (held_out NULL becomes false);
without any label, or with one class only, all scores are that of no evidence.
Only doc_id and text of documents are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jetlake.llm.common import bounded_texts, columns, free_name, mixed, slices, small, staged, texts_of

HISTORY = 5
DISCOUNT = 0.75
DEAD_ZONE = 3.0
CURVE_ROWS = 20_000
HELD = 400_000  # symbols that a worker counts at once

_LETTERS = np.array([chr(code).isalpha() for code in range(0xD800)])
_WEIGHTS = mixed(np.arange(1, HISTORY + 3, dtype=np.uint64)) | np.uint64(1)


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each symbol with its history, of the history, of the symbol with the shortened history; word starts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([codes, [0]]).astype(np.uint64)
    basic = codes < len(_LETTERS)
    letter = ~basic
    letter[basic] = _LETTERS[codes[basic].astype(np.int64)]
    codes[~letter] = 0
    place = np.arange(len(codes))
    last_gap = np.maximum.accumulate(np.where(letter, -1, place))
    last_gap = np.concatenate([[-1], last_gap[:-1]])  # the gap before each symbol
    inside = place - last_gap - 1  # letters before it in its word
    history = np.minimum(inside, HISTORY).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shorter = np.zeros(len(codes), np.uint64)
    for back in range(1, HISTORY + 1):
        if back < HISTORY:
            shorter = history.copy() if back == 1 else shorter
        before = np.concatenate([np.zeros(back, np.uint64), codes[:-back]]) if len(codes) > back else np.zeros(len(codes), np.uint64)
        part = np.where(inside >= back, before * _WEIGHTS[back], np.uint64(0))
        history = history + part
        if back < HISTORY:
            shorter = shorter + part
    used = letter | (inside > 0)
    symbol = codes * _WEIGHTS[0] + _WEIGHTS[HISTORY + 1]
    starts = np.flatnonzero(used & (inside == 0))
    numbering = np.cumsum(used) - 1
    return (mixed(history + symbol)[used], mixed(history)[used],
            mixed(shorter + symbol + np.uint64(7))[used], numbering[starts])


def _counted(batches):
    """(g, h, s, toxic, ordinary): grams counted within the task's rows before they are exchanged."""
    held, weights = [], []
    size = 0

    def flush():
        gram, history, shorter = (np.concatenate(part) for part in zip(*held))
        classes = np.concatenate(weights)
        values, first, place = np.unique(gram, return_index=True, return_inverse=True)
        toxic = np.bincount(place, weights=classes, minlength=len(values)).astype(np.int64)
        total = np.bincount(place, minlength=len(values)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(v.view(np.int64)) for v in (values, history[first], shorter[first])), pa.array(toxic), pa.array(total - toxic)],
            names=["g", "h", "s", "toxic", "ordinary"])

    for batch in slices(batches):
        for text, label in zip(texts_of(batch), batch.column("toxic").to_pylist()):
            gram, history, shorter, _ = grams(text)
            if len(gram):
                held.append((gram, history, shorter))
                weights.append(np.full(len(gram), float(label)))
                size += len(gram)
        if size > HELD:
            yield flush()
            held, weights, size = [], [], 0
    if size:
        yield flush()


def counts(labelled: DataFrame) -> DataFrame:
    """(g, h, s, toxic, ordinary) over all rows (text, toxic)."""
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        _counted, "g long, h long, s long, toxic long, ordinary long")
    return rows.groupBy("g", "h", "s").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def without(counted: DataFrame, own: DataFrame) -> DataFrame:
    """Counts less those of some of their rows; grams that only these had are gone."""
    names = ("toxic", "ordinary")
    total = (counted.unionByName(own.select("g", "h", "s", *((-F.col(n)).alias(n) for n in names)))
             .groupBy("g", "h", "s").agg(*(F.sum(n).alias(n) for n in names)))
    return total.where(F.col("toxic") + F.col("ordinary") > 0)


def ratios(counted: DataFrame) -> DataFrame:
    """(kind, key, ratio): log-likelihood ratios of grams (kind 0) and of unseen successors of a history (kind 1)."""
    # Continuations: distinct histories of a symbol after the shortened history, and of anything after it.
    symbol = counted.groupBy("s").agg(F.count("*").alias("after"))
    per_history = counted.groupBy("h").agg(
        F.sum("toxic").alias("nt"), F.sum("ordinary").alias("no"),
        F.sum((F.col("toxic") > 0).cast("long")).alias("tt"), F.sum((F.col("ordinary") > 0).cast("long")).alias("to"),
        F.count("*").alias("types"))
    rows = counted.join(per_history, "h").join(symbol, "s")
    # B(x | h'): continuations of x relative to the successors of the history, at most 1.
    backoff = F.least(F.lit(1.0), F.col("after") / (F.col("after") + F.col("types")))
    # A history that a class has not seen weighs its backoff fully.
    rest = lambda types, n: F.when(F.col(n) > 0, DISCOUNT * F.col(types) / F.col(n)).otherwise(1.0)
    own = lambda x, n: F.when(F.col(n) > 0, F.greatest(F.col(x) - DISCOUNT, F.lit(0.0)) / F.col(n)).otherwise(0.0)
    seen = F.log((own("toxic", "nt") + rest("tt", "nt") * backoff) / (own("ordinary", "no") + rest("to", "no") * backoff))
    by_gram = rows.select(F.col("g").alias("key"), seen.alias("ratio"))
    by_history = per_history.select(F.col("h").alias("key"), F.log(rest("tt", "nt") / rest("to", "no")).alias("ratio"))
    tagged = lambda df, kind: df.select(F.lit(kind).alias("kind"), "key", F.col("ratio").cast("float").alias("ratio"))
    return tagged(by_gram, 0).unionAll(tagged(by_history, 1))


class Ratios:
    """Ratios by 64-bit key: sorted keys, entered by their leading bits."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.concatenate([keys[order], np.array([2**64 - 1], np.uint64)])
        self.ratios = np.concatenate([ratios[order], np.array([np.nan], np.float32)])
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        starts = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.starts = np.searchsorted(self.keys[:-1], starts).astype(np.int32 if len(keys) < 2**31 else np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The ratio of each key, NaN where there is none."""
        place = self.starts[keys >> self.shift].astype(np.int64)
        behind = np.flatnonzero(self.keys[place] < keys)
        while len(behind):
            place[behind] += 1
            behind = behind[self.keys[place[behind]] < keys[behind]]
        return np.where(self.keys[place] == keys, self.ratios[place], np.float32(np.nan))


def model_arrays(table: DataFrame) -> tuple[Ratios, Ratios]:
    """Ratios of grams and of unseen successors of a history."""
    rows = table.toArrow()
    kind, key, ratio = (rows.column(name).to_numpy() for name in ("kind", "key", "ratio"))
    return tuple(Ratios(key[kind == k].astype(np.int64).view(np.uint64), ratio[kind == k].astype(np.float32)) for k in (0, 1))


def evidence(text: str, seen: Ratios, unseen: Ratios) -> float:
    gram, history, _, starts = grams(text)
    if not len(starts):
        return 0.0
    value = seen.of(gram)
    unknown = np.flatnonzero(np.isnan(value))
    value[unknown] = np.nan_to_num(unseen.of(history[unknown]))  # a history without ratio is no evidence
    words = np.add.reduceat(value.astype(np.float64), starts)
    return float(np.maximum(words - DEAD_ZONE, 0).sum() / len(words))


def with_evidence(docs: DataFrame, model) -> DataFrame:
    """doc_id, text's evidence, and any further narrow column of ``docs``."""
    further = [name for name in docs.columns if name != "text"]

    def run(batches):
        seen, unseen = model.value
        for batch in slices(batches):
            values = [evidence(text, seen, unseen) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in further), pa.array(values, pa.float64())],
                                             names=[*further, "evidence"])

    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in docs.schema if field.name != "text")
    return docs.mapInArrow(run, f"{schema}, evidence double")


def fit_curve(values: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """Logistic curve over log(1 + evidence / scale), by Newton's method with a small ridge."""
    if not len(values) or labels.min() == labels.max():
        return 1.0, 1.0, -4.0
    positive = values[values > 0]
    scale = float(np.median(positive)) * 0.1 if len(positive) else 1.0
    x = np.stack([np.log1p(values / scale), np.ones(len(values))], axis=1)
    weights = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (labels - p) - 1e-3 * weights
        curvature = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        weights = weights + np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    return scale, float(weights[0]), float(weights[1])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with doc_id, held_out, score, predicted."""
    return _scored(docs, labels)[0]


def _scored(docs: DataFrame, labels: DataFrame):
    """The scores and the broadcast model that they need."""
    spark = docs.sparkSession
    docs = columns(docs, "doc_id", "text")
    marks = staged(labels.where("doc_id is not null and toxic is not null")
                   .groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
                   .withColumn("fold", remainder(F.col("l_id"))).where("fold <> 0"), "marks")
    labelled = lambda folds: docs.join(
        small(marks.where(F.col("fold").isin(folds))), F.col("doc_id") == F.col("l_id")).select("toxic", "text")
    counted = staged(counts(labelled([1, 2, 3, 4])), "counts")

    def model(table):
        classes = table.agg(F.sum("toxic"), F.sum("ordinary")).first()
        found = ratios(table)
        return spark.sparkContext.broadcast(model_arrays(found if classes[0] and classes[1] else found.limit(0)))

    # A bounded sample of labelled rows fits the two numbers of the curve, read without what it and its copies taught.
    calibration = bounded_texts(labelled([1]), CURVE_ROWS)
    texts = staged(calibration.select(F.xxhash64("text").alias("__t")), "sample")
    own = labelled([1, 2, 3, 4]).withColumn("__t", F.xxhash64("text")).join(small(texts), "__t", "left_semi")
    others = model(staged(without(counted, counts(own)), "counts"))
    fitted = with_evidence(calibration, others).toArrow()
    others.unpersist()
    trained = model(counted)
    scale, slope, level = fit_curve(fitted.column("evidence").to_numpy(), fitted.column("toxic").to_numpy().astype(float))
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.log1p(F.col("evidence") / F.lit(scale)) + F.lit(level))))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return (with_evidence(docs, trained).withColumn("score", score)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))), trained


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the model does not reject, columns as they came; rows without id stay."""
    scored, model = _scored(docs, labels)
    name = free_name(docs, "rejected_id")
    rejected = staged(scored.where("predicted = 1 and doc_id is not null")
                      .select(F.col("doc_id").alias(name)).distinct(), "rejected")
    model.unpersist()
    return docs.join(small(rejected), F.col("doc_id") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
