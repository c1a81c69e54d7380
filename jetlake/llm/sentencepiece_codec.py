"""SentencePiece encoding and decoding with a max-plus scan over long documents.

A text of one chunk is encoded where it is read.  A longer one is cut into
chunks of ``CHUNK`` characters that are spread over the cluster.  For a chunk,
entry i means that the piece before it reaches i characters into it, exit j
that its own last piece reaches j characters into the next one; the transfer
matrix holds the best score for each (i, j).  Matrices multiply associatively
in the max-plus sense, so the scores at all boundaries of a document come from
a scan in a logarithmic number of steps.  They fix the entry and exit of each
chunk, and every chunk is then traced back on its own.

Only the parts before the first and after the last place in a chunk that no
piece crosses depend on entry and exit; what lies between is scored once.

Decoding joins the bytes of the pieces and drops the leading space that
encoding put in front; every text comes back exactly.

Defined results: null and empty texts have no tokens and decode to the empty
text; rows without id and repeated rows are encoded like any other; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetlake.llm.common import slices, small, staged, texts_of
from jetlake.llm.unigram import NEVER, Lattice, Vocabulary, forward, load, pieces, segment, units

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16_384
CACHED_UNITS, CACHED_LENGTH = 300_000, 40
BLOCK = 8192  # units segmented together

_CHUNKS = "id string, doc_id long, chunk int, body string, ahead string"
_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder:
    """Segments units and remembers the common ones, in bounded memory.

    New units of a piece of the input are segmented together.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.lattice = Lattice(vocabulary)
        self.known: dict[str, bytes] = {}
        self.scored: dict[str, float] = {}

    def _learn(self, found: set[str]):
        """Segment the units that are not known yet; the long ones are left out."""
        new = [unit for unit in found.difference(self.known) if len(unit) <= CACHED_LENGTH]
        if len(self.known) + len(new) > CACHED_UNITS:
            self.known.clear()
            self.scored.clear()
            new = [unit for unit in found if len(unit) <= CACHED_LENGTH]
        new.sort(key=len)
        for start in range(0, len(new), BLOCK):
            block = new[start:start + BLOCK]
            ids, scores = self.lattice.segmented(block)
            self.known.update(zip(block, ids))
            self.scored.update(zip(block, scores))

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers in one string of bytes."""
        split = [units(text, self.vocabulary) for text in texts]
        self._learn(set().union(*split))
        known, out = self.known.get, []
        for words in split:
            found = list(map(known, words))
            if None in found:
                found = [np.array(segment(unit, self.vocabulary), np.int32).tobytes() if ids is None else ids
                         for unit, ids in zip(words, found)]
            out.append(b"".join(found))
        return out

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]

    def score(self, text: str) -> float:
        words = units(text, self.vocabulary)
        self._learn(set(words))
        return sum(self.scored[u] if len(u) <= CACHED_LENGTH else forward(u, self.vocabulary)[0][-1] for u in words)

    def decoded(self, ids: bytes) -> bytes:
        return decoded(ids, self.vocabulary)


def decoded(ids: bytes, vocabulary: Vocabulary) -> bytes:
    return b"".join(map(vocabulary.texts.__getitem__, np.frombuffer(ids, np.int32).tolist()))


def cut_places(body: str, vocabulary: Vocabulary) -> tuple[int, int] | None:
    """First and last place of a chunk that no piece crosses and no entry reaches beyond; None if there is none."""
    if not vocabulary.splits:
        return None
    first = None
    at = vocabulary.longest
    while (at := body.find(" ", at)) >= 0:
        if body[at - 1] != " ":
            first = at
            break
        at += 1
    if first is None:
        return None
    last = len(body)
    while (last := body.rfind(" ", 0, last)) > first:
        if body[last - 1] != " ":
            return first, last
    return first, first


def _entries(count: int, offset: int) -> list[float]:
    return [NEVER] * offset + [0.0] + [NEVER] * (count - offset - 1)


def transfer_matrix(body: str, ahead: str, encoder: Encoder) -> np.ndarray:
    """Best score from entry i to exit j; unreachable ones are -inf."""
    vocabulary = encoder.vocabulary
    size, length = vocabulary.longest, len(body)
    matrix = np.full((size, size), NEVER)
    cuts = cut_places(body, vocabulary)
    whole = body + ahead

    def exits(best, starts, shift):
        row = np.full(size, NEVER)
        for j in range(min(size, len(whole) - length + 1)):
            end = length + j - shift
            # beyond the boundary only a piece that begins before it counts
            if j == 0:
                row[0] = best[end]
            else:
                for begin in range(max(0, end - size), length - shift):
                    score = vocabulary.scores.get(whole[begin + shift:end + shift])
                    if score is not None and best[begin] + score > row[j]:
                        row[j] = best[begin] + score
        return row

    if cuts is None:
        for i in range(min(size, length + 1)):
            best, starts = forward(body, vocabulary, _entries(i + 1, i))
            matrix[i] = exits(best + [NEVER] * size, starts, 0)
        return matrix
    first, last = cuts
    tail, starts = forward(body[last:], vocabulary)
    ending = exits(tail + [NEVER] * size, starts, last) + encoder.score(body[first:last])
    head = body[:first]
    for i in range(min(size, length + 1)):
        matrix[i] = forward(head[i:], vocabulary)[0][-1] + ending
    return matrix


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices or of stacks of them."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def boundary_states(matrices: np.ndarray) -> list[int]:
    """Entry of each chunk and exit of the last on a best path: prefix products by doubling, then back from the end."""
    prefix, step = matrices.copy(), 1
    while step < len(prefix):
        prefix[step:] = product(prefix[:-step].copy(), prefix[step:])
        step *= 2
    states = [0]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(prefix[k - 1][0] + matrices[k][:, states[-1]])))
    return [0, *states[::-1]] if len(matrices) > 1 else [0, 0]


def encoded_chunk(body: str, ahead: str, entry: int, leaving: int, encoder: Encoder) -> bytes:
    """Ids of the chunk between its two boundary states."""
    vocabulary, text = encoder.vocabulary, body + ahead[:leaving]
    number = lambda part: np.array(segment(part, vocabulary), np.int32).tobytes()
    cuts = cut_places(body, vocabulary)
    if cuts is not None:
        first, last = cuts
        ids = number(text[entry:first]) + encoder.ids(text[first:last])
        start = last
    else:
        ids, start = b"", entry
    if leaving == 0:
        return ids + number(text[start:])
    part, boundary = text[start:], len(body) - start
    best, starts = forward(part[:boundary], vocabulary)
    top, begin = max(((best[at] + vocabulary.scores[part[at:]], -at) for at in range(max(0, len(part) - vocabulary.longest), boundary)
                      if part[at:] in vocabulary.scores))
    head = pieces(part[:boundary], starts, vocabulary, -begin)
    return ids + np.array([*head, vocabulary.ids[part[-begin:]]], np.int32).tobytes()


def _chunks(batches, chunk, ahead):
    partition, number = TaskContext.get().partitionId(), 0
    for batch in slices(batches, 16):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            text, number = " " + text, number + 1
            for k, start in enumerate(range(0, len(text), chunk)):
                end = start + chunk
                rows.append((f"{partition}-{number}", doc, k, text[start:end], text[end:end + ahead]))
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))],
            names=["id", "doc_id", "chunk", "body", "ahead"])


def _matrices(batches, vocabulary):
    encoder = Encoder(vocabulary)
    for batch in slices(batches, 16):
        found = [transfer_matrix(body, ahead, encoder).tobytes()
                 for body, ahead in zip(batch.column("body").to_pylist(), batch.column("ahead").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("chunk"), pa.array(found, pa.binary())],
                                         names=["id", "chunk", "matrix"])


def _scanned(table: pa.Table) -> pa.Table:
    """Entry and exit of every chunk of one document, from its matrices."""
    table = table.sort_by("chunk")
    stack = np.stack([np.frombuffer(m) for m in table.column("matrix").to_pylist()])
    size = int(np.sqrt(stack.shape[1]))
    states = boundary_states(stack.reshape(-1, size, size))
    return pa.table({"id": table.column("id"), "chunk": table.column("chunk"),
                     "entry": pa.array(states[:-1], pa.int32()), "leaving": pa.array(states[1:], pa.int32())})


def _traced(batches, vocabulary):
    encoder = Encoder(vocabulary)
    for batch in slices(batches, 16):
        ids = [encoded_chunk(*row, encoder) for row in zip(*(batch.column(n).to_pylist() for n in ("body", "ahead", "entry", "leaving")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("doc_id"), batch.column("chunk"), pa.array(ids, pa.binary())],
            names=["id", "doc_id", "chunk", "ids"])


def _whole(batches, vocabulary):
    encoder = Encoder(vocabulary)
    for batch in slices(batches, 128):
        ids = encoder.all_ids([" " + text if text else "" for text in texts_of(batch)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def _joined(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    return pa.table({"doc_id": table.column("doc_id").slice(0, 1),
                     "ids": pa.array([b"".join(table.column("ids").to_pylist())], pa.binary())})


def _encoded(docs: DataFrame, model: str, chunk: int, finished, schema: str) -> DataFrame:
    """``finished(batches, vocabulary)`` of the batches (doc_id, ids), in the tasks that encode: one Python worker each."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load(model))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ahead = vocabulary.value.longest - 1
    short = (docs.where(F.char_length("text") < chunk)
             .mapInArrow(lambda batches: finished(_whole(batches, vocabulary.value), vocabulary.value), schema))
    chunks = staged(docs.where(F.char_length("text") >= chunk)
                    .mapInArrow(lambda batches: _chunks(batches, chunk, ahead), _CHUNKS).repartition("id", "chunk"), "chunks")
    matrices = chunks.mapInArrow(lambda batches: _matrices(batches, vocabulary.value), "id string, chunk int, matrix binary")
    states = staged(matrices.groupBy("id").applyInArrow(_scanned, "id string, chunk int, entry int, leaving int"), "states")
    traced = (chunks.join(small(states), ["id", "chunk"])
              .mapInArrow(lambda batches: _traced(batches, vocabulary.value), "id string, doc_id long, chunk int, ids binary"))
    long = traced.groupBy("id").applyInArrow(
        lambda table: pa.Table.from_batches(finished(_joined(table).to_batches(), vocabulary.value)), schema)
    return short.unionAll(long)


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """Every row of ``docs`` with doc_id and ids, the token ids as 32-bit integers in native byte order."""
    return _encoded(docs, model, chunk, lambda batches, _: batches, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Every row of ``encoded`` with doc_id and the text its ids stand for."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        for batch in slices(batches):
            texts = [decoded(ids or b"", vocabulary.value)[1:].decode("utf-8", "surrogatepass") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digested(batches, vocabulary):
    for batch in slices(batches):
        ids = batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
            pa.array([hashlib.sha256(decoded(i, vocabulary)[1:]).hexdigest() for i in ids])],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids) and decoded_sha256 (decoded text) of every row."""
    return _encoded(docs, model, chunk, _digested, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
