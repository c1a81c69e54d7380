"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns give the base spans (e-mail, IPv4 address, payment card, phone).
The field reads regions, whole runs of words with digits or an at sign wherever
in the word these stand, as sequences of atoms (digit runs, letter runs, single
signs).  A candidate segment is any run of up to ``LONGEST`` atoms; features of
the whole segment (numbers of digits and groups, signs used, check digit, shape
of its ends, what stands around it) score it for each type, and dynamic
programming over segments chooses boundaries and types together, over a region of
any length at once.  Atoms outside entities are segments of their own.  Weights
maximise the conditional likelihood of the base spans in the first ``REGIONS``
pieces of regions, in the order of the texts, of at most ``TRAINING_ROWS``
documents, so the field learns what a span of each type looks like and adds
look-alikes that the patterns miss, such as a number written without its plus
sign.  Only the training reads pieces; none ends within a span that it teaches.
Base spans always stay; an added span overlaps none.

Defined results: null and empty texts have no spans; rows without id and
repeated rows are searched like any other; without any base span in the
training rows nothing is added; an empty table gives an empty result.  Texts of
any length are searched in time linear in their length.  Only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetlake.llm.common import bounded_texts, slices, texts_of

KINDS = ("email", "ip", "card", "phone")
LONGEST = 14
TRAINING_ROWS, REGIONS, EPOCHS = 400, 500, 6
REGION_ATOMS = 60  # of a piece for the training
REMEMBERED = 256  # characters of the segments whose features are remembered

# Possessive repeats and run starts keep the search linear; the matches are those of the plain patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_REGION = re.compile(r"(?:(?<!\S)[^\s0-9@]*+[0-9@]\S*+ ?)++")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|\S| ")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = at + 1  # no match can reach over this sign
        at = text.find("@", max(free, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; kind is the position in KINDS."""
    spans = [(start, 0, end) for start, end in emails(text)]
    if _DIGITS.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(spans)


def regions(text: str) -> list[tuple[int, list[tuple[int, int]]]]:
    """Start and atoms (start, end) of each region."""
    return [(m.start(), [atom.span() for atom in _ATOM.finditer(text, m.start(), m.end())]) for m in _REGION.finditer(text)]


def _bucket(value: int, bounds: tuple[int, ...]) -> int:
    return sum(value >= b for b in bounds)


@lru_cache(50_000)
def span_features(span: str, before: str, after: str) -> tuple[str, ...]:
    """Features of a whole segment and its neighbours."""
    digits = [d for d in span if "0" <= d <= "9"]
    groups = re.findall(r"[0-9]+", span)
    letters = sum(c.isalpha() for c in span)
    signs = "".join(sorted({c for c in span if not c.isalnum()}))
    side = lambda c: "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else c
    features = [
        f"digits{_bucket(len(digits), (1, 4, 7, 9, 12, 16, 17, 20))}", f"groups{min(len(groups), 6)}", f"signs{signs[:8]}",
        f"letters{_bucket(letters, (1, 4, 12))}", f"ends{side(span[0])}{side(span[-1])}",
        f"before{side(before)}", f"after{side(after)}", f"outer{span[0].isalnum() and before.isalnum()}{span[-1].isalnum() and after.isalnum()}",
        "bias"]
    if "@" in span:
        features.append(f"at{bool(re.fullmatch(r'[^@ ]+@[^@ ]+[.][^@ ]+', span))}")
    if len(groups) == 4 and signs == ".":
        features.append(f"quad{all(len(g) < 4 and int(g) < 256 for g in groups)}{letters == 0}")
    if 12 <= len(digits) <= 19 and not letters:
        features.append(f"check{luhn(''.join(digits))}")
    return tuple(features)


class SemiMarkov:
    """Weights by (type, feature) and by (type, next type); type 0 is outside and has single atoms only."""

    def __init__(self, weights: dict | None = None):
        self.weights = weights or {}
        self._scores: dict = {}

    def scores(self, features: tuple[str, ...]) -> list[float]:
        found = self._scores.get(features)
        if found is None:
            get = self.weights.get
            found = [sum(get((kind, f), 0.0) for f in features) for kind in range(1, len(KINDS) + 1)]
            if len(self._scores) < 100_000:
                self._scores[features] = found
        return found

    def ending(self, text: str, atoms: list[tuple[int, int]], end: int):
        """Candidate segments before the atom ``end``: (begin, features); those that begin or end with a space are none."""
        stop = atoms[end - 1][1]
        if text[stop - 1] == " ":
            return []
        found, after = [], text[stop:stop + 1]
        for begin in range(max(0, end - LONGEST), end):
            start = atoms[begin][0]
            if text[start] != " ":
                features = span_features if stop - start <= REMEMBERED else span_features.__wrapped__
                found.append((begin, features(text[start:stop], text[start - 1:start], after)))
        return found

    def segments(self, text: str, atoms: list[tuple[int, int]]):
        """Candidate segments by their end."""
        return [[], *(self.ending(text, atoms, end) for end in range(1, len(atoms) + 1))]

    def best(self, text: str, atoms: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Entities (begin, end, kind) of the best segmentation."""
        table, back = [0.0], [None]
        for end in range(1, len(atoms) + 1):
            top, choice = table[end - 1], None
            for begin, features in self.ending(text, atoms, end):
                for kind, score in enumerate(self.scores(features), 1):
                    if table[begin] + score > top:
                        top, choice = table[begin] + score, (begin, kind)
            table.append(top)
            back.append(choice)
        found, end = [], len(atoms)
        while end:
            if back[end] is None:
                end -= 1
            else:
                begin, kind = back[end]
                found.append((begin, end, kind))
                end = begin
        return found[::-1]

    def fit(self, examples, epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 1e-4):
        """Adaptive gradient ascent on the conditional log-likelihood; examples are (text, atoms, entities)."""
        squares: dict = {}
        prepared = [(self.segments(text, atoms), gold) for text, atoms, gold in examples]
        for _ in range(epochs):
            for ends, gold in prepared:
                self._scores = {}
                count = len(ends) - 1
                scored = [[(b, f, self.scores(f)) for b, f in ends[e]] for e in range(count + 1)]
                forward = np.zeros(count + 1)
                for e in range(1, count + 1):
                    forward[e] = np.logaddexp.reduce([forward[e - 1], *(forward[b] + s for b, _, ss in scored[e] for s in ss)])
                backward = np.full(count + 1, -np.inf)
                backward[count] = 0.0
                for e in range(count, 0, -1):
                    backward[e - 1] = np.logaddexp(backward[e - 1], backward[e])
                    for b, _, ss in scored[e]:
                        backward[b] = np.logaddexp(backward[b], backward[e] + np.logaddexp.reduce(ss))
                gradient: dict = {}
                for e in range(1, count + 1):
                    for b, features, ss in scored[e]:
                        for kind, s in enumerate(ss, 1):
                            p = float(np.exp(min(forward[b] + s + backward[e] - forward[count], 0.0)))
                            p = ((b, e, kind) in gold) - p
                            if abs(p) > 1e-4:
                                for f in features:
                                    gradient[kind, f] = gradient.get((kind, f), 0.0) + p
                for key, g in gradient.items():
                    g -= ridge * self.weights.get(key, 0.0)
                    squares[key] = squares.get(key, 0.0) + g * g
                    self.weights[key] = self.weights.get(key, 0.0) + rate * g / (1e-6 + squares[key] ** 0.5)
        self._scores = {}
        return self


def pieces(text: str, atoms: list[tuple[int, int]], gold: list[tuple[int, int, int]]):
    """(atoms, gold) of a region's pieces, gold in order: cut after REGION_ATOMS atoms at the next space, at the latest after four times as many, within no span of gold."""
    first, place = 0, 0
    for cut in range(1, len(atoms) + 1):
        while place < len(gold) and gold[place][1] <= cut:
            place += 1
        size, inside = cut - first, place < len(gold) and gold[place][0] < cut
        if cut == len(atoms) or not inside and (size >= REGION_ATOMS and text[atoms[cut - 1][0]] == " " or size >= 4 * REGION_ATOMS):
            yield atoms[first:cut], {(begin - first, end - first, kind) for begin, end, kind in gold[:place]}
            first, gold, place = cut, gold[place:], 0


def train(texts: list[str], limit: int = REGIONS) -> dict:
    """Weights from the base spans of the given texts; only spans made of whole atoms are taught."""
    examples = []
    for text in texts:
        spans = base_spans(text)
        for _, atoms in regions(text):
            if len(examples) >= limit:
                break
            starts = {a[0]: k for k, a in enumerate(atoms)}
            stops = {a[1]: k + 1 for k, a in enumerate(atoms)}
            gold = {(starts[s], stops[e], kind + 1) for s, kind, e in spans if s in starts and e in stops and stops[e] - starts[s] <= LONGEST}
            taken, chosen = -1, []
            for begin, end, kind in sorted(gold):
                if begin >= taken:
                    chosen.append((begin, end, kind))
                    taken = end
            examples += [(text, *piece) for piece in islice(pieces(text, atoms, chosen), limit - len(examples))]
    if not any(gold for _, _, gold in examples):
        return {}
    return SemiMarkov().fit(examples).weights


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov) -> list[tuple[int, int, int]]:
    if not model.weights:
        return []
    found, place = [], 0
    for _, atoms in regions(text):
        for begin, end, kind in model.best(text, atoms):
            start, stop = atoms[begin][0], atoms[end - 1][1]
            if not any(s < stop and start < e for s, _, e in base):
                found.append((start, kind - 1, stop))
    return found


def written(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _searched(batches, weights):
    model = SemiMarkov(weights)
    names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_added"]
    for batch in slices(batches):
        counts, digests, lists, added = [[] for _ in KINDS], [], [], []
        for text in texts_of(batch):
            base = base_spans(text)
            more = added_spans(text, base, model)
            for kind in range(len(KINDS)):
                counts[kind].append(sum(k == kind for _, k, _ in base))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            lists.append(written(base + more))
            added.append(len(more))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
             pa.array(lists, pa.string()), pa.array(added, pa.int64())], names=names)


def find(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, base spans by kind (n_email, n_ip, n_card, n_phone), base_sha256, spans, n_added of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = bounded_texts(docs.where(F.col("text").rlike("[0-9@]")).select("text"), training_rows).collect()
    weights = docs.sparkSession.sparkContext.broadcast(train(sorted(r.text for r in sample)))
    return docs.mapInArrow(
        lambda batches: _searched(batches, weights.value),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
