"""Token counts by a trie of pre-tokens that shares the forward scores of their beginnings.

The distinct new pre-tokens of a piece of the input are sorted and inserted into
a trie level by level.  A node stands for a beginning and holds its best unigram
score and the number of tokens on that path, computed once from the nodes above
it, whatever number of pre-tokens begin so; a level is a few array operations
over all its nodes.  A pre-token's count is read at its last node and remembered.
The counts are those of ``sentencepiece_codec``.

Memory: a piece holds at most ``PORTION`` characters, or one text without a place
to cut; texts are cut only between pre-tokens.  The trie is ``DEPTH`` deep: a
longer pre-token goes on from the scores of its last places there, one letter
after the other, and keeps only the beginnings from which a piece may still go
on.  At most ``KNOWN`` counts of pre-tokens within that depth are remembered.  None of this changes a count.

Defined results: null and empty texts have no tokens; rows without id and
repeated rows are counted like any other; very long texts, also those without
any space, are counted whole; an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetlake.llm.common import slices, texts_of
from jetlake.llm.sentencepiece_codec import MODEL
from jetlake.llm.unigram import NEVER, Lattice, Vocabulary, load, units

DEPTH, KNOWN, PORTION = 64, 400_000, 1_000_000


def continued(unit: str, at: int, best: list[float], tokens: list[int], vocabulary: Vocabulary) -> int:
    """Tokens of the unit from those of its places up to ``at``; the lists end with that of ``at``."""
    score_of, shift = vocabulary.prefixes.get, at - len(best) + 1
    going = [(begin, best[begin - shift], tokens[begin - shift]) for begin in range(max(shift, at - vocabulary.longest), at)
             if unit[begin:at] in vocabulary.prefixes]
    base, count = best[-1], tokens[-1]
    for end in range(at + 1, len(unit) + 1):
        top, taken, still = NEVER, 0, []
        for arc in (*going, (end - 1, base, count)):
            score = score_of(unit[arc[0]:end])
            if score is not None:
                still.append(arc)
                if arc[1] + score > top:
                    top, taken = arc[1] + score, arc[2] + 1
        letter = unit[end - 1]
        if letter not in vocabulary.scores and base + vocabulary.unknown > top:
            top, taken = base + vocabulary.unknown, count + len(letter.encode("utf-8", "surrogatepass"))
        base, count, going = top, taken, still
    return count


class Trie:
    """Counts tokens of many pre-tokens together; ``nodes`` is the number of beginnings scored."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pieces, self.nodes = vocabulary, Lattice(vocabulary), 0

    def _below(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The pieces' trie one letter further; 0 where no piece goes on."""
        if not len(self.pieces.keys):
            return np.zeros(len(nodes), np.int32)
        wanted = nodes.astype(np.int64) << 21 | letters
        at = np.minimum(np.searchsorted(self.pieces.keys, wanted), len(self.pieces.keys) - 1)
        return np.where(self.pieces.keys[at] == wanted, self.pieces.below[at], 0)

    def counts(self, distinct: list[str]) -> list[int]:
        """Tokens of each pre-token; they are distinct, sorted and not empty."""
        if not distinct:
            return []
        pieces, unknown, last = self.pieces, self.vocabulary.unknown, self.vocabulary.longest
        sizes = np.fromiter((min(len(u), DEPTH) for u in distinct), np.int64, len(distinct))
        letters = np.frombuffer("".join(u[:DEPTH] for u in distinct).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        offsets = np.cumsum(sizes) - sizes
        found = np.zeros(len(distinct), np.int64)
        long = np.flatnonzero(np.fromiter((len(u) > DEPTH for u in distinct), bool, len(distinct)))
        trail: list[tuple[np.ndarray, np.ndarray]] = []  # scores and tokens of the long ones at the last depths
        # The level at hand: a node's score and tokens, and the arcs from beginnings at or above it that pieces may prolong.
        node, alive = np.zeros(len(distinct), np.int64), np.arange(len(distinct))
        best, tokens = np.zeros(1), np.zeros(1, np.int64)
        first, many = np.zeros(1, np.int64), np.zeros(1, np.int64)
        base, base_tokens, reached = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for depth in range(int(sizes.max())):
            if len(long) and depth >= DEPTH - last:
                trail.append((best[node[long]], tokens[node[long]]))
            alive = alive[sizes[alive] > depth]
            codes, above = letters[offsets[alive] + depth], node[alive]
            fresh = np.ones(len(alive), bool)
            fresh[1:] = (above[1:] != above[:-1]) | (codes[1:] != codes[:-1])
            parent, letter = above[fresh], codes[fresh]
            node[alive] = np.cumsum(fresh) - 1
            self.nodes += len(parent)
            # Arcs of the parents go on with the letter; behind them, in order of their beginnings, one begins.
            owner = np.repeat(np.arange(len(parent)), many[parent])
            within = np.arange(len(owner)) - np.repeat(np.cumsum(many[parent]) - many[parent], many[parent])
            arc = first[parent][owner] + within
            ahead = self._below(reached[arc], letter[owner])
            kept = ahead > 0
            begun = pieces.root[letter]
            new = begun > 0
            owner = np.concatenate([owner[kept], np.flatnonzero(new)])
            order = np.argsort(owner, kind="stable")
            owner = owner[order]
            base = np.concatenate([base[arc[kept]], best[parent[new]]])[order]
            base_tokens = np.concatenate([base_tokens[arc[kept]], tokens[parent[new]]])[order]
            reached = np.concatenate([ahead[kept], begun[new]])[order]
            many = np.bincount(owner, minlength=len(parent))
            first = np.cumsum(many) - many
            # Of equal sums the longest last piece, which is the first arc.
            sums = base + pieces.score[reached]
            top = np.full(len(parent), NEVER)
            some = np.flatnonzero(many)
            if len(some):
                top[some] = np.maximum.reduceat(sums, first[some])
            hits = np.flatnonzero((sums > NEVER) & (sums == top[owner]))
            hits = hits[np.diff(owner[hits], prepend=-1) > 0]
            taken = np.zeros(len(parent), np.int64)
            taken[owner[hits]] = base_tokens[hits] + 1
            raw = best[parent] + unknown
            bare = (pieces.score[begun] == NEVER) & (raw > top)
            width = 1 + (letter >= 0x80) + (letter >= 0x800) + (letter >= 0x10000)
            best, tokens = np.where(bare, raw, top), np.where(bare, tokens[parent] + width, taken)
            ended = alive[sizes[alive] == depth + 1]
            found[ended] = tokens[node[ended]]
        result = found.tolist()
        if len(long):
            trail.append((best[node[long]], tokens[node[long]]))
            scores, amounts = (np.stack(part, axis=1).tolist() for part in zip(*trail))
            for k, row, amount in zip(long.tolist(), scores, amounts):
                result[k] = continued(distinct[k], DEPTH, row, amount, self.vocabulary)
        return result


def parts(text: str, vocabulary: Vocabulary, size: int = PORTION):
    """The text in parts of about ``size`` characters, cut where a pre-token ends."""
    start = 0
    while vocabulary.splits and len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and text[cut - 1] == " ":
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def portions(texts: list[str], vocabulary: Vocabulary, size: int = PORTION):
    """Lists of (place of the text, part), of about ``size`` characters."""
    held, total = [], 0
    for place, text in enumerate(texts):
        for part in parts(" " + text, vocabulary, size) if text else ():
            held.append((place, part))
            total += len(part)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def _counted(batches, vocabulary: Vocabulary):
    trie, known = Trie(vocabulary), {}
    for batch in slices(batches, 4096):
        texts = texts_of(batch)
        n_tokens, n_units = [0] * len(texts), [0] * len(texts)
        for portion in portions(texts, vocabulary):
            split = [units(part, vocabulary) for _, part in portion]
            distinct = set().union(*split)
            new = sorted(distinct.difference(known))
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = sorted(distinct)
            known.update(zip(new, trie.counts(new)))
            for (place, _), words in zip(portion, split):
                n_tokens[place] += sum(map(known.__getitem__, words))
                n_units[place] += len(words)
            for unit in [u for u in new if len(u) > DEPTH]:
                del known[unit]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(n_units, pa.int64())],
            names=["doc_id", "n_tokens", "n_pretokens"])


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Every row of ``docs`` with doc_id, n_tokens and n_pretokens."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _counted(batches, vocabulary.value), "doc_id long, n_tokens long, n_pretokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
