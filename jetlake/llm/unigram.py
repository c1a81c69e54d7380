"""Unigram segmentation with the pieces and scores of a SentencePiece model.

The best segmentation has the greatest sum of piece scores.  Of equal sums the
one with the longest last piece wins, from the end of a unit towards its start.
A character that no piece covers costs the least score minus ten and becomes
its UTF-8 bytes.  Spaces stand for the model's space sign; the sign itself, if a
text holds it, is written as bytes, so that decoding gives back every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np

SPACE = "▁"
NEVER = float("-inf")
_UNITS = re.compile(r" *[^ ]+| +")


@dataclass
class Vocabulary:
    scores: dict[str, float]  # piece, with plain spaces
    ids: dict[str, int]
    byte_ids: list[int]
    longest: int = 0
    unknown: float = 0.0
    splits: bool = True  # no piece has a space after another character
    texts: dict[int, bytes] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)  # score of a piece, NEVER for what only begins one

    def __post_init__(self):
        self.longest = max(map(len, self.scores))
        self.unknown = min(self.scores.values()) - 10
        self.splits = not any(" " in piece.lstrip(" ") for piece in self.scores)
        self.prefixes = {piece[:k]: self.scores.get(piece[:k], NEVER) for piece in self.scores for k in range(1, len(piece) + 1)}
        self.texts = {number: piece.encode() for piece, number in self.ids.items()}
        self.texts |= {number: bytes([value]) for value, number in enumerate(self.byte_ids)}


def load(path: str) -> Vocabulary:
    """Pieces, scores and byte pieces of a model file with byte fallback; read on the driver, sent by broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, ids = {}, {}
    for number in range(model.get_piece_size()):
        if model.is_unknown(number) or model.is_control(number) or model.is_byte(number) or model.is_unused(number):
            continue
        piece = model.id_to_piece(number).replace(SPACE, " ")
        scores[piece], ids[piece] = model.get_score(number), number
    byte_ids = [model.piece_to_id(f"<0x{value:02X}>") for value in range(256)]
    return Vocabulary(scores, ids, byte_ids)


def units(text: str, vocabulary: Vocabulary) -> list[str]:
    """Parts that no piece crosses: spaces and what follows them; the whole text if pieces may cross."""
    return _UNITS.findall(text) if vocabulary.splits else [text] if text else []


def step(text: str, end: int, best: list[float], vocabulary: Vocabulary, first: int = 0) -> tuple[float, int]:
    """Score and start of the best last piece of ``text[:end]``; best holds the scores of the ends before it."""
    top, start, score_of = NEVER, -1, vocabulary.scores.get
    for begin in range(max(first, end - vocabulary.longest), end):
        score = score_of(text[begin:end])
        if score is not None and best[begin] + score > top:
            top, start = best[begin] + score, begin
    if text[end - 1] not in vocabulary.scores and best[end - 1] + vocabulary.unknown > top:
        top, start = best[end - 1] + vocabulary.unknown, end - 1
    return top, start


def forward(text: str, vocabulary: Vocabulary, entry: list[float] | None = None) -> tuple[list[float], list[int]]:
    """Best score of each end and the start of its last piece; ``entry`` gives the scores of the first ends."""
    size, score_of = len(text), vocabulary.prefixes.get
    best = [0.0] if entry is None else list(entry)
    best += [NEVER] * (size + 1 - len(best))
    starts = [-1] * len(best)
    for begin in range(size):
        base = best[begin]
        if base == NEVER:
            continue
        for end in range(begin + 1, size + 1):
            score = score_of(text[begin:end])
            if score is None:
                break
            if base + score > best[end]:
                best[end], starts[end] = base + score, begin
        if text[begin] not in vocabulary.scores and base + vocabulary.unknown > best[begin + 1]:
            best[begin + 1], starts[begin + 1] = base + vocabulary.unknown, begin
    return best, starts


def pieces(text: str, starts: list[int], vocabulary: Vocabulary, end: int | None = None) -> list[int]:
    """Ids along the best path that ends at ``end``."""
    end, found = len(text) if end is None else end, []
    while starts[end] >= 0:
        piece = text[starts[end]:end]
        number = vocabulary.ids.get(piece)
        if number is None:
            found.extend(vocabulary.byte_ids[value] for value in reversed(piece.encode("utf-8", "surrogatepass")))
        else:
            found.append(number)
        end = starts[end]
    return found[::-1]


def segment(text: str, vocabulary: Vocabulary) -> list[int]:
    return pieces(text, forward(text, vocabulary)[1], vocabulary)


def _utf8_byte(codes: np.ndarray, size: np.ndarray, number: int) -> np.ndarray:
    """Byte ``number`` of the UTF-8 forms, ``size`` bytes long, of code points."""
    bits = codes >> 6 * (size - 1 - number)
    if number:
        return 0x80 | bits & 0x3F
    return np.where(size == 1, codes, 256 - (1 << 8 - size) | bits)


class Lattice:
    """Segments many short units together: one step per depth of the pieces' trie and one per beginning.

    The same rule and the same sums as ``forward``, whose inner loops become
    array operations over all units.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        numbers = {prefix: k for k, prefix in enumerate(vocabulary.prefixes, 1)}
        self.root = np.zeros(0x110000, np.int32)
        keys, below = [], []
        for prefix, number in numbers.items():
            if len(prefix) == 1:
                self.root[ord(prefix)] = number
            else:
                keys.append(numbers[prefix[:-1]] << 21 | ord(prefix[-1]))
                below.append(number)
        order = np.argsort(keys)
        self.keys, self.below = np.array(keys, np.int64)[order], np.array(below, np.int32)[order]
        self.score = np.array([NEVER, *vocabulary.prefixes.values()])
        self.bytes = np.array(vocabulary.byte_ids, np.int32)
        self.piece = np.array([-1, *(vocabulary.ids.get(prefix, -1) for prefix in numbers)], np.int32)

    def _arcs(self, letters: np.ndarray, left: np.ndarray):
        """(place, length, node) of every piece in the letters; ``left`` counts those up to the end of the unit.

        A letter that is no piece gets an arc of node 0.
        """
        places, nodes, depth = np.arange(len(letters)), self.root[letters], 1
        found = [(places, np.where(self.score[nodes] > NEVER, nodes, 0))]
        while True:
            going = (nodes > 0) & (left[places] > depth)
            places, nodes = places[going], nodes[going]
            if not len(places) or not len(self.keys):
                break
            wanted = nodes.astype(np.int64) << 21 | letters[places + depth]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            nodes = np.where(self.keys[at] == wanted, self.below[at], 0)
            depth += 1
            piece = self.score[nodes] > NEVER
            found.append((places[piece], nodes[piece]))
        lengths = np.repeat(np.arange(1, len(found) + 1), [len(p) for p, _ in found])
        return np.concatenate([p for p, _ in found]), lengths, np.concatenate([n for _, n in found])

    def segmented(self, units: list[str]) -> tuple[list[bytes], list[float]]:
        """Ids (32-bit integers as bytes) and score of each unit; units are not empty."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        offsets = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(units)), sizes)
        within = np.arange(len(letters)) - offsets[word]
        places, lengths, nodes = self._arcs(letters, (sizes[word] - within))
        begins = within[places]
        order = np.argsort(begins, kind="stable")
        begins, nodes = begins[order], nodes[order]
        width = int(sizes.max()) + 1
        sources = word[places[order]] * width + begins
        ends = sources + lengths[order]
        scores = np.where(nodes > 0, self.score[nodes], self.vocabulary.unknown)
        best = np.full(len(units) * width, NEVER)
        best[::width] = 0.0
        arc = np.full(len(best), -1, np.int64)
        # Arcs of one beginning have different ends, so that none overwrites another.
        for low, high in pairwise(np.searchsorted(begins, np.arange(width))):
            sums = best[sources[low:high]] + scores[low:high]
            better = np.flatnonzero(sums > best[ends[low:high]])
            best[ends[low:high][better]] = sums[better]
            arc[ends[low:high][better]] = better + low
        last = np.arange(len(units)) * width + sizes
        at, alive, path, owners = last.copy(), np.arange(len(units)), [], []
        while len(alive):
            taken = arc[at]
            path.append(taken)
            owners.append(alive)
            at = sources[taken]
            going = at % width > 0
            at, alive = at[going], alive[going]
        path, owners = np.concatenate(path)[::-1], np.concatenate(owners)[::-1]
        order = np.argsort(owners, kind="stable")
        path, owners = path[order], owners[order]
        ids, repeats = self.piece[nodes[path]], np.ones(len(path), np.int64)
        raw = np.flatnonzero(nodes[path] == 0)
        if len(raw):
            codes = letters[offsets[owners[raw]] + begins[path[raw]]]
            repeats[raw] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            ids = np.repeat(ids, repeats)
            first = np.cumsum(repeats)[raw] - repeats[raw]
            for number in range(4):
                some = repeats[raw] > number
                ids[first[some] + number] = self.bytes[_utf8_byte(codes[some], repeats[raw][some], number)]
            owners = np.repeat(owners, repeats)
        joined, bounds = ids.tobytes(), (4 * np.searchsorted(owners, np.arange(len(units) + 1))).tolist()
        return [joined[low:high] for low, high in pairwise(bounds)], best[last].tolist()
