"""SentencePiece encoding and decoding with the N best segmentations.

The pieces of a public model span a lattice over the text; a segmentation is a path and its score
the sum of its pieces' scores in the model file. A forward Viterbi pass gives, for every place, the
best score of any path from the start to it. The N best paths are found by A-star search backwards
from the end: what a partial path still has to gain is exactly the Viterbi score of the place it has
reached, so paths leave the queue in order of their full score and none is expanded in vain.

No piece has a word mark behind another character, and in most vocabularies none goes on behind the
letters of a word (both are checked). So a text falls apart there, and the lattice is a chain of
small ones. Parts that repeat are searched once per worker. The N best
of the chain come from the N best of its parts: only the parts whose second path costs least can
deviate within the first N.

A merge vocabulary (its scores are ranks of merges) encodes by merging, and a sum of ranks does not
find that segmentation. Two neighbours are compatible if merging their joined text gives just these two;
the only path whose neighbours all are is the model's own encoding. So there the lattice carries pairs:
a path loses ``CROSSING`` for each border that merging would cross, which no sum of ranks makes up for.
Viterbi and A-star run over its edges and deliver the model's encoding first, then the paths that merging
would cross least. Elsewhere the best sum is the model's own encoding.

Encoding is exact on whole texts: a mark stands for a space (a mark inside a text becomes one), one mark leads the text, other white
space stays as it is, a character without a piece falls back to its bytes. Decoding gives the text
back. A null text counts as empty; empty texts have one segmentation without pieces and score 0.
Of equal scores the path whose pieces start earlier, seen from the end, comes first.
"""

from __future__ import annotations

import heapq
import os
import re
from bisect import insort
from collections.abc import Iterable
from functools import cache
from itertools import chain
from operator import itemgetter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import map_batches

MARK = "▁"


def part_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Cuts a marked text where no piece can stand over the border.

    That is before a run of marks, behind the letters of a word, and around line ends. Letters
    that some piece has before another character are no letters here, so the cut is right for
    any vocabulary whose marks lead their pieces.
    """
    pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
    if any(b == MARK != a for a, b in pairs):
        raise ValueError("a piece has a mark behind another character")
    bound: set[str] = set()
    while True:
        letter = rf"[^\W\d_{re.escape(''.join(sorted(bound)))}]"
        more = {a for a, b in pairs if re.match(letter, a) and not re.match(letter, b)}
        if not more:
            break
        bound |= more
    line = "" if any("\n" in p for p in pairs) else "\n"
    other = rf"(?:(?!{letter})[^{MARK}{line}])"
    return re.compile((rf"{line}|" if line else "") + rf"{MARK}*+{other}*+{letter}++|{MARK}++{other}*+|{other}++")


# Remembered parts and pairs per Python worker, some 70 and 50 MB; beyond them the memory is emptied and filled anew.
REMEMBERED, PAIRS = 200_000, 500_000
# What a path loses for each border that merging would cross.
CROSSING = 1e9
NEVER = -float("inf")
# Texts whose segmentations a task holds at once.
SLICE = 100
# Longest part, in characters, that is remembered.
SHORT = 64
Path = tuple[float, tuple[int, ...]]
# Best score and pieces, what the second path loses, whether decoding all paths gives the part back.
Part = tuple[float, tuple[int, ...], float, bool]


def start_of_trail() -> tuple[str, list[list], list[list]]:
    """A text, the lattice edges that end at each of its places, and the pieces that could still grow there."""
    return "", [[(0.0, 0, -1, 0.0)]], [[]]


class Pieces:
    """The pieces of a model, with segmentation and its inverse."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = [model.get_score(i) for i in range(size)]
        self.ids = {self.names[i]: i for i in normal}
        self.byte_of = {i: int(self.names[i][3:-1], 16) for i in range(size) if model.is_byte(i)}
        self.bytes = {b: i for i, b in self.byte_of.items()}
        # runs of marks that the model rules out by a boundless penalty stay possible, at the cost of their marks
        real = [self.scores[i] for i in normal if self.scores[i] > -1e6]
        self.floor = min(real, default=0.0) - 10.0
        # scores that are all whole numbers, no two alike, are ranks of merges
        self.merges = len(set(real)) == len(real) and all(s == int(s) for s in real)
        self.trie = self._trie()
        self.cut = part_pattern(self.ids)
        self.parts: dict[tuple[int, bool], dict[str, Part]] = {}
        self.crossed: dict[int, float] = {}
        self.made: dict[int, float] = {}
        self.longest = max(map(len, self.ids))
        self.trail = start_of_trail()

    def _trie(self) -> dict:
        """Character -> (node below, piece that ends here or -1, its score)."""
        root: dict = {}
        for piece, number in sorted(self.ids.items()):
            node = root
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, -1, 0.0))[0]
            below = node.get(piece[-1], ({}, -1))[0]
            node[piece[-1]] = (below, number, self.scores[number])
        return root

    def edges(self, text: str, start: int) -> list[tuple[int, float, int]]:
        """(end, score, piece) of every lattice edge from ``start``; piece -1: bytes of one character."""
        found, node, end = [], self.trie, start
        for c in text[start:start + self.longest]:
            hit = node.get(c)
            if hit is None:
                break
            node, piece, score = hit
            end += 1
            if piece >= 0:
                found.append((end, score, piece))
        if not found or found[0][0] > start + 1:
            found.append((start + 1, self.floor, -1))
        return found

    def n_best(self, text: str, n: int) -> list[Path]:
        """(score, pieces) of the n best paths through the lattice of one part."""
        size, root, floor, longest = len(text), self.trie, self.floor, self.longest
        incoming: list[list[tuple[float, int, int]]] = [[] for _ in range(size + 1)]
        best = [0.0] + [float("-inf")] * size
        for start in range(size):  # forward Viterbi over the edges; every place can be reached
            at, node, end = best[start], root, start
            for c in text[start:start + longest]:
                hit = node.get(c)
                if hit is None:
                    break
                node, piece, score = hit
                end += 1
                if piece >= 0:
                    score += at
                    incoming[end].append((score, start, piece))
                    if score > best[end]:
                        best[end] = score
            alone = incoming[start + 1]
            if not alone or alone[-1][1] != start:  # no piece for the character itself: its bytes
                score = at + floor
                alone.append((score, start, -1))
                if score > best[start + 1]:
                    best[start + 1] = score
        # Backward A-star. A partial path is known by what it loses against the best one: the Viterbi
        # scores tell exactly what the rest adds. Every entry leads to a path of its loss, so no more
        # are kept than paths are still wanted. Of equal losses the one nearest to the start goes
        # first, so equal paths are finished one by one.
        queue: list[tuple] = [(0.0, size, 0, None)]
        found, order = [], 0
        while queue and len(found) < n:
            loss, place, _, behind = queue.pop(0)
            if place == 0:
                pieces: list[int] = []
                while behind is not None:
                    start, piece, behind = behind
                    pieces += (piece,) if piece >= 0 else self._bytes(text[start])
                found.append((best[size] - loss, tuple(pieces)))
                continue
            top, wanted = best[place], n - len(found)
            for score, start, piece in incoming[place]:
                lost = loss + (top - score)
                if len(queue) < wanted or lost <= queue[-1][0]:
                    order += 1
                    insort(queue, (lost, start, order, (start, piece, behind)))
                    del queue[wanted:]
        return found

    def _bytes(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")]

    def merge(self, text: str) -> Path:
        """Score and pieces of the merge encoding: of all neighbours that form a piece the best go together first."""
        size, ids, scores = len(text), self.ids, self.scores
        # a symbol is known by its start; ``end`` is 0 where none starts, ``begin`` tells where the one before ends
        end, begin, queue = list(range(1, size + 1)), list(range(-1, size)), []

        def offer(start: int) -> None:
            middle = end[start]
            if middle < size:
                piece = ids.get(text[start:end[middle]]) if end[middle] - start <= self.longest else None
                if piece is not None:
                    heapq.heappush(queue, (-scores[piece], start, end[middle]))

        for start in range(size):
            offer(start)
        while queue:
            _, start, stop = heapq.heappop(queue)
            middle = end[start]
            if not middle or middle >= stop or end[middle] != stop:
                continue
            end[start], end[middle], begin[stop] = stop, 0, start
            offer(start)
            if start:
                offer(begin[start])
        total, pieces, at = 0.0, [], 0
        while at < size:
            piece = ids.get(text[at:end[at]])
            total += self.floor if piece is None else scores[piece]
            pieces += self._bytes(text[at]) if piece is None else (piece,)
            at = end[at]
        return total, tuple(pieces)

    def _crossing(self, left: int, right: int) -> float:
        """What a path loses where ``right`` follows ``left`` (-1: the start): merging would join over the border, or never make ``right``."""
        if len(self.crossed) >= PAIRS:
            self.crossed.clear()
        names, lost = self.names, self.made.get(right)
        if lost is None:
            lost = self.made[right] = 0.0 if self.merge(names[right])[1] == (right,) else CROSSING
        if left >= 0 and self.merge(names[left] + names[right])[1] != (left, right):
            lost += CROSSING
        self.crossed[(left + 1) << 20 | right] = lost
        return lost

    def n_best_merged(self, text: str, n: int) -> list[Path]:
        """(score, pieces) of the n best paths of one part, a score being the sum less the crossings.

        A piece that the model rules out by a boundless penalty, but merging makes, costs ``floor`` here.
        """
        size, crossed, crossing = len(text), self.crossed, self._crossing
        root, floor, key = self.trie, self.floor, itemgetter(0)
        # An edge: best score of a path that ends with it, where it starts, its piece, its own score. What ends
        # up to a place depends on the text before it only, so the part before gives what it shares.
        known, ending, growing = self.trail
        at, shared = 0, min(size, len(known))
        while at < shared and text[at] == known[at]:
            at += 1
        del ending[at + 1:], growing[at + 1:]
        for place in range(at, size):
            c, found, longer = text[place], [], []
            # best first: an edge before whose score can't reach the best so far ends the look, as borders only cost
            own = sorted(ending[place], key=key, reverse=True) if len(ending[place]) > 1 else ending[place]
            for start, node, here in chain(growing[place], ((place, root, own),)):
                hit = node.get(c)
                if hit is None:
                    continue
                node, piece, score = hit
                if node:
                    longer.append((start, node, here))
                if piece >= 0:
                    top = NEVER
                    for before in here:
                        reach = before[0]
                        if reach <= top:
                            break
                        lost = crossed.get(before[2] + 1 << 20 | piece)
                        reach -= crossing(before[2], piece) if lost is None else lost
                        if reach > top:
                            top = reach
                    if score < floor:
                        score = floor
                    found.append((top + score, start, piece, score))
            if not found or found[-1][1] != place:  # no piece for the character itself: its bytes
                found.append((own[0][0] + floor, place, -1, floor))
            ending.append(found)
            growing.append(longer)
        self.trail = (text, ending, growing) if size <= SHORT else start_of_trail()
        best = max(map(key, ending[size]))
        # Backward A-star as in ``n_best``, from edge to edge; only edges on the way are asked for all before them.
        queue: list[tuple] = sorted((best - e[0], size, i, e, None) for i, e in enumerate(ending[size]))[:n]
        found, order = [], len(ending[size])
        while queue and len(found) < n:
            loss, place, _, edge, behind = queue.pop(0)
            if place == 0:
                pieces: list[int] = []
                while behind is not None:
                    (_, start, piece, _), behind = behind
                    pieces += (piece,) if piece >= 0 else self._bytes(text[start])
                found.append((best - loss, tuple(pieces)))
                continue
            top, start, piece, score = edge
            wanted = n - len(found)
            for before in ending[start]:
                lost = loss + (top - before[0] - score)
                if len(queue) >= wanted and lost > queue[-1][0]:
                    continue
                if piece >= 0:
                    border = crossed.get(before[2] + 1 << 20 | piece)
                    lost += crossing(before[2], piece) if border is None else border
                    if len(queue) >= wanted and lost > queue[-1][0]:
                        continue
                order += 1
                insort(queue, (lost, start, order, before, (edge, behind)))
                del queue[wanted:]
        return found

    def encode_own_first(self, text: str, n: int) -> list[Path]:
        """The model's own encoding of a whole text, and the n - 1 best other segmentations."""
        return self.paths(text, n, True)[1]

    def part(self, text: str, n: int, own: bool) -> Part:
        """One part, searched and remembered."""
        paths = self._search(text, n, own)
        loss = paths[0][0] - paths[1][0] if len(paths) > 1 else float("inf")
        known = (*paths[0], loss, all(self.raw(p) == text for _, p in paths))
        if len(text) <= SHORT:
            parts = self.parts.setdefault((n, own), {})
            if len(parts) >= REMEMBERED:
                parts.clear()
            parts[text] = known
        return known

    def remember(self, texts: Iterable[str | None], n: int, own: bool) -> None:
        """Search the short parts of texts in order, so that each shares the lattice of its beginning with the one before."""
        known = self.parts.setdefault((n, own), {})
        parts = chain.from_iterable(self.cut.findall(self.marked(t or "")) for t in texts)
        for part in sorted({p for p in parts if len(p) <= SHORT and p not in known}):
            self.part(part, n, own)

    def _search(self, text: str, n: int, own: bool) -> list[Path]:
        return self.n_best_merged(text, n) if own and self.merges else self.n_best(text, n)

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode(self, text: str) -> Path:
        """Score and pieces of the best segmentation."""
        return self.encode_n_best(text, 1)[0]

    def encode_n_best(self, text: str, n: int) -> list[Path]:
        """The n best segmentations of a whole text, by the sums of their scores alone."""
        return self.paths(text, n, False)[1]

    def paths(self, text: str, n: int, own: bool) -> tuple[list[Part], list[Path]]:
        """The parts of a whole text, and its n best segmentations."""
        texts, known, part = self.cut.findall(self.marked(text)), self.parts.setdefault((n, own), {}), self.part
        parts = [known.get(p) or part(p, n, own) for p in texts]
        # a part outside these deviates only after n - 1 cheaper single deviations
        loose = sorted(heapq.nsmallest(n - 1, range(len(parts)), key=lambda i: (parts[i][2], i))) if n > 1 else []
        choices = {i: self._search(texts[i], n, own) for i in loose if parts[i][2] < float("inf")}
        # sums of one choice per loose part, best first: (score, which choice in each)
        kept: list[tuple[float, tuple[int, ...]]] = [(sum(map(itemgetter(0), parts)), ())]
        for paths in choices.values():
            kept = heapq.nsmallest(
                n, ((s - paths[0][0] + path[0], c + (k,)) for s, c in kept for k, path in enumerate(paths)), key=lambda x: (-x[0], x[1])
            )
        result = []
        for score, chosen in kept:
            pieces = list(map(itemgetter(1), parts))
            for i, k in zip(choices, chosen):
                pieces[i] = choices[i][k][1]
            result.append((score, tuple(chain.from_iterable(pieces))))
        return parts, result

    def raw(self, pieces) -> str:
        """The marked text of pieces."""
        if self.byte_of.keys().isdisjoint(pieces):
            return "".join([self.names[i] for i in pieces])
        out, run = [], bytearray()
        for i in pieces:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(run.decode("utf-8", "surrogatepass"))
            out.append(self.names[i])
            run = bytearray()
        return "".join(out) + run.decode("utf-8", "surrogatepass")

    def decode(self, pieces) -> str:
        """The text of a segmentation."""
        return self.raw(pieces).replace(MARK, " ")[1:]


@cache
def model(name: str) -> Pieces:
    """One model per Python worker; ``name`` is looked up where the task runs."""
    import public_tokenizers

    return Pieces(name if os.path.exists(name) else public_tokenizers.path(name))


def encode(docs: DataFrame, n: int = 2, tokenizer: str = "piece_bpe_32k.model", text_col: str = "text") -> DataFrame:
    """doc_id, pieces, score, others: the model's own encoding and the n - 1 best others as (score, pieces)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(b):
        encoder = model(tokenizer)
        encoder.remember(b["text"], n, True)
        found = [encoder.encode_own_first(t or "", n) for t in b["text"]]
        return {
            "doc_id": b["doc_id"], "pieces": [f[0][1] for f in found], "score": [f[0][0] for f in found],
            "others": [[{"score": s, "pieces": p} for s, p in f[1:]] for f in found],
        }

    schema = "doc_id bigint, pieces array<int>, score double, others array<struct<score: double, pieces: array<int>>>"
    return map_batches(rows, run, schema, rows=SLICE)


def decode(encoded: DataFrame, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, text from rows of (doc_id, pieces)."""
    return map_batches(
        encoded.select("doc_id", "pieces"),
        lambda b: {"doc_id": b["doc_id"], "text": [model(tokenizer).decode(p) for p in b["pieces"]]}, "doc_id bigint, text string",
    )


def segmentation_digest(docs: DataFrame, n: int = 2, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pieces, score, n_paths, second_score, round_trip, pieces_crc.

    Encodes each whole text and decodes its segmentations again, part by part; the pieces
    themselves stay in the task, so the result is small. ``second_score`` is null for n = 1.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    names = "doc_id n_pieces score n_paths second_score round_trip pieces_crc".split()

    def run(b):
        encoder, out = model(tokenizer), {c: [] for c in names}
        encoder.remember(b["text"], n, True)
        for i, text in zip(b["doc_id"], b["text"]):
            parts, paths = encoder.paths(text or "", n, True)
            pieces = np.array(paths[0][1], dtype=np.int32)
            whole = MARK not in (text or "") and all(map(itemgetter(3), parts))
            row = (i, len(pieces), paths[0][0], len(paths), paths[1][0] if len(paths) > 1 else None, whole, crc32(pieces.tobytes()))
            for c, v in zip(names, row):
                out[c].append(v)
        return out

    return map_batches(
        rows, run, "doc_id bigint, n_pieces bigint, score double, n_paths int, second_score double, round_trip boolean, pieces_crc bigint",
        rows=SLICE,
    )
