"""Near duplicates by SimHash fingerprints and the generalised pigeonhole principle.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 values have it set.
Fingerprints link at ``distance`` or fewer differing bits. The 64 bits are dealt into parts, bits
that go together into the same part, as far as their correlation over all distinct fingerprints
tells. Every fingerprint allocates a threshold t_i >= -1 to each part so that the sum of (t_i + 1)
is distance + 1: a fingerprint within the distance then differs by at most t_i bits in some part i,
whatever the allocation (-1: the part is not looked at). Which allocation is cheapest is found by
dynamic programming over the parts, on candidate counts estimated from histograms of the parts'
values. All values within t_i bits of the own value are probed; what stands there is verified.

The number of parts follows from the number of distinct fingerprints (about as many bits to a part
as keep a value's bucket small), at any size. Only distinct fingerprints are joined, so copies cost
nothing; a value that holds many of them becomes a grid of blocks of probing and standing
fingerprints. A task passes on the links of a spanning forest, never all pairs; the components of
the forest are those of all links.

Null and empty texts, and texts without words, have the fingerprint zero and are linked like any
other. Texts with fewer words than a shingle are one shingle. Repeated ids are rows of their own; a
null id gets the smallest id of its component too, which is null only if no document there has an id.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import slices
from codequarry.llm.components import components
from codequarry.llm.matrices import summed
from codequarry.sources.storage import written

SEED = 42
# Bytes of a text that are cut into words at a time.
CHUNK = 1 << 20
# Bits of the values that a histogram counts; wider parts have several.
HISTOGRAM_BITS = 16
# Costs of sending a probe and of verifying a candidate, relative to each other.
PROBE, VERIFY = 1.0, 0.02
# Standing fingerprints of a region on average; of one value in a block; pairs verified at a time.
REGION, BLOCK, PAIRS = 8_000, 32_768, 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _shingle_bytes(data: bytes, size: int) -> Iterator[list[bytes]]:
    """The shingles of a lower-cased text, in lists; a text of fewer words is one shingle."""
    carry, at, found = [], 0, False
    while at < len(data):
        end = _SPACE.search(data, at + CHUNK) if at + CHUNK < len(data) else None
        stop = end.start() if end else len(data)
        words, at = carry + data[at:stop].split(), stop
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            yield [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
            found = True
        carry = words[len(words) - size + 1 :] if len(words) >= size else words
    if carry and not found:
        yield [b" ".join(carry)]


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for shingles in _shingle_bytes((text or "").encode().lower(), size):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(shingles)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (a long with the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "fingerprint"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id bigint, fingerprint bigint")


def _bits(words: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each word, lowest bit first."""
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _words(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8").ravel()


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, e) for e in range(radius + 1))


def _masks(width: int, radius: int) -> np.ndarray:
    """All patterns of at most ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for e in range(radius + 1) for c in combinations(range(width), e)], dtype=np.uint64)


def _cut(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def number_of_parts(n: int, distance: int) -> int:
    """Parts for ``n`` fingerprints: least cost if all bits were even and independent."""

    def cost(parts: int) -> float:
        return sum(
            _ball(w, u - 1) * (PROBE + VERIFY * n / 2**w) for w, u in zip(_cut(64, parts), _cut(distance + 1, parts)) if u
        )

    return min(range(1, 2 * (distance + 1) + 1), key=cost)


def grouped_bits(joint: np.ndarray, n: int, widths: list[int]) -> list[int]:
    """An order of the bits in which each part's bits go together.

    ``joint`` counts the fingerprints that have both bits. A part starts with the bit most correlated
    with those left, and takes the bit most correlated with its own until it is full.
    """
    share = np.diag(joint) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs(joint / n - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, order = list(range(64)), []
    for width in widths:
        part = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (related[b, part].sum(), -b)))
            left.remove(part[-1])
        order += part
    return order


@dataclass
class Index:
    """How fingerprints are arranged into parts, and how often the values of the parts occur."""

    n: int
    distance: int
    widths: list[int]
    order: list[int]
    block: int  # standing fingerprints of one value in a block
    near: list[list[np.ndarray]]  # per piece: share of fingerprints at 0, 1, ... bits from each value

    def pieces(self) -> list[tuple[int, int, int]]:
        """(part, first bit, bits) of each piece that a histogram counts."""
        found, at = [], 0
        for i, width in enumerate(self.widths):
            for w in _cut(width, -(-width // HISTOGRAM_BITS)):
                found.append((i, at, w))
                at += w
        return found

    def arranged(self, words: np.ndarray) -> np.ndarray:
        return _words(_bits(words)[:, self.order])

    def restored(self, words: np.ndarray) -> np.ndarray:
        return _words(_bits(words)[:, np.argsort(self.order)])

    def values(self, words: np.ndarray) -> list[np.ndarray]:
        """The value of each part in arranged words."""
        found, at = [], 0
        for width in self.widths:
            found.append((words >> np.uint64(at)) & np.uint64(2**width - 1))
            at += width
        return found

    def _shares(self, part: int, values: np.ndarray) -> list[np.ndarray]:
        """Per piece of the part, rows of shares at 0, 1, ... bits from the values."""
        start, found = sum(self.widths[:part]), []
        for (i, at, w), near in zip(self.pieces(), self.near):
            if i == part:
                local = ((values >> np.uint64(at - start)) & np.uint64(2**w - 1)).astype(np.int64)
                found.append(np.stack([shares[local] for shares in near]))
        return found

    def candidates(self, part: int, values: np.ndarray) -> np.ndarray:
        """Estimated fingerprints within 0, 1, ... bits of the values, a row for each radius.

        Exact for parts of one piece; pieces of one part count as independent.
        """
        pieces = self._shares(part, values)
        joint = pieces[0]
        for other in pieces[1:]:
            joint = np.stack([sum(joint[a] * other[e - a] for a in range(e + 1)) for e in range(self.distance + 1)])
        return self.n * np.cumsum(joint, axis=0)

    def blocks(self, part: int, values: np.ndarray) -> np.ndarray:
        """Blocks a side for the fingerprints that stand at the values; no value has more than counted here."""
        most = self.n * np.minimum.reduce([p[0] for p in self._shares(part, values)])
        return np.maximum(1, np.ceil(most / self.block)).astype(np.int64)

    def allocation(self, words: np.ndarray) -> np.ndarray:
        """Threshold + 1 of each part (a column each) for arranged words: the cheapest by the estimates."""
        units = self.distance + 1
        best = np.full((units + 1, len(words)), np.inf)
        best[0] = 0
        chosen = []
        for i, values in enumerate(self.values(words)):
            found = self.candidates(i, values)
            cost = [np.zeros(len(words))] + [PROBE * _ball(self.widths[i], u - 1) + VERIFY * found[u - 1] for u in range(1, units + 1)]
            ways = np.stack([np.stack([best[s - u] + cost[u] if u <= s else np.full(len(words), np.inf) for u in range(units + 1)]) for s in range(units + 1)])
            chosen.append(ways.argmin(1))
            best = ways.min(1)
        left, result, rows = np.full(len(words), units), [], np.arange(len(words))
        for choice in reversed(chosen):
            result.append(choice[left, rows])
            left = left - result[-1]
        return np.stack(result[::-1], axis=1)


def build_index(distinct: DataFrame, distance: int, parts: int | None = None, block: int = BLOCK) -> Index | None:
    """Statistics of all distinct fingerprints (column fingerprint): pair counts of bits, histograms of values."""
    n = distinct.count()
    if not n:
        return None

    def words_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(batch.schema.get_field_index("fingerprint")).to_numpy().view(np.uint64)

    def together(batch: pa.RecordBatch) -> np.ndarray:
        bits = _bits(words_of(batch)).astype(np.float64)
        return bits.T @ bits

    only = distinct.select("fingerprint")
    widths = _cut(64, parts or number_of_parts(n, distance))
    index = Index(n, distance, widths, grouped_bits(summed(only, together, 64, 64), n, widths), block, [])
    pieces = index.pieces()

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2**w, dtype=np.int64) for _, _, w in pieces]
        for batch in batches:
            words = index.arranged(words_of(batch))
            for c, (_, at, w) in zip(counts, pieces):
                c += np.bincount(((words >> np.uint64(at)) & np.uint64(2**w - 1)).astype(np.int64), minlength=2**w)
        for j, c in enumerate(counts):
            there = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there), j, dtype=np.int32)), pa.array(there.astype(np.int32)), pa.array(c[there])], names=["piece", "value", "n"]
            )

    # as many rows as the histograms have counters, however many fingerprints there are
    got = only.mapInArrow(histograms, "piece int, value int, n bigint").groupBy("piece", "value").agg(F.sum("n").alias("n")).toArrow()
    piece, value, count = (got.column(c).to_numpy() for c in ("piece", "value", "n"))
    for j, (_, _, w) in enumerate(pieces):
        counts, every = np.zeros(2**w), np.arange(2**w)
        counts[value[piece == j]] = count[piece == j]
        near = []
        for e in range(distance + 1):
            at_e = np.zeros(2**w)
            for c in combinations(range(w), e):
                at_e += counts[every ^ sum(1 << b for b in c)]
            near.append(at_e / n)
        index.near.append(near)
    return index


def _mixed(part: int, values: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """A 64-bit key of a part's value and a cell of its grid; equal keys of others only add candidates."""
    x = values ^ (np.uint64(part + 1) << np.uint64(58)) ^ (row.astype(np.uint64) << np.uint64(40)) ^ (column.astype(np.uint64) << np.uint64(49))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


STANDS, PROBES = 1, 2


def _signatures(index: Index, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(keys, arranged words, what they do there)."""
    words = index.arranged(words)
    units = index.allocation(words)
    salt = _mixed(0, words, np.zeros(len(words)), np.zeros(len(words))) >> np.uint64(8)

    def spread(part: int, at: np.ndarray, values: np.ndarray, own_column: bool) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all cells of the own row or column of each value's grid, and the words there."""
        side = index.blocks(part, values)
        each = np.repeat(np.arange(len(values)), side)
        other = np.arange(len(each)) - np.repeat(np.cumsum(side) - side, side)
        own = (salt[at] % side.astype(np.uint64)).astype(np.int64)[each]
        row, column = (other, own) if own_column else (own, other)
        return _mixed(part, values[each], row, column), words[at[each]]

    for i, values in enumerate(index.values(words)):
        every = np.arange(len(words))
        single = (index.blocks(i, values) == 1) & (units[:, i] > 0)
        yield _mixed(i, values[single], *(np.zeros(single.sum(), dtype=np.int64),) * 2), words[single], STANDS | PROBES
        yield *spread(i, every[~single], values[~single], False), STANDS
        for u in np.unique(units[:, i]):
            if u:
                at = np.flatnonzero(units[:, i] == u)
                for k, mask in enumerate(_masks(index.widths[i], int(u) - 1)):
                    asking = at if k else at[~single[at]]
                    if len(asking):
                        yield *spread(i, asking, values[asking] ^ mask, True), PROBES


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest node of its component."""
    nodes, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = inverse[: len(x)], inverse[len(x) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        after = after[after]
        if (after == label).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]
        label = after


def _verified(keys: np.ndarray, words: np.ndarray, does: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between probing and standing words of equal keys."""
    stands = np.flatnonzero(does & STANDS)
    stands = stands[np.argsort(keys[stands], kind="stable")]
    probes = np.flatnonzero(does & PROBES)
    low = np.searchsorted(keys[stands], keys[probes], "left")
    n = np.searchsorted(keys[stands], keys[probes], "right") - low
    probes, low, n = probes[n > 0], low[n > 0], n[n > 0]
    ends = np.cumsum(n)
    x, y = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        pair = np.arange(first, min(first + PAIRS, int(ends[-1])))
        probe = np.searchsorted(ends, pair, "right")
        asked = words[probes[probe]]
        there = words[stands[low[probe] + pair - (ends[probe] - n[probe])]]
        linked = (asked != there) & (np.bitwise_count(asked ^ there) <= distance)
        if linked.any():
            x, y = _forest(np.concatenate([x, asked[linked]]), np.concatenate([y, there[linked]]))
    return x, y


def links(distinct: DataFrame, distance: int = 3, parts: int | None = None, block: int = BLOCK) -> DataFrame | None:
    """x, y: a forest of the links between fingerprints that differ in at most ``distance`` bits.

    ``distinct`` has each fingerprint once; its components are those of all links.
    """
    index = build_index(distinct, distance, parts, block)
    if index is None:
        return None
    spark = distinct.sparkSession
    regions = max(1, -(-index.n * len(index.widths) // REGION))
    shared = spark.sparkContext.broadcast(index)
    names = ["region", "key", "word", "does"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            for keys, words, does in _signatures(shared.value, batch.column("fingerprint").to_numpy().view(np.uint64)):
                region = (keys % np.uint64(regions)).astype(np.int32)
                does = np.full(len(keys), does, dtype=np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(keys.view(np.int64)), pa.array(words.view(np.int64)), pa.array(does)], names=names)

    def meet(group: pa.Table) -> pa.Table:
        keys, words, does = (group.column(c).to_numpy() for c in names[1:])
        x, y = _verified(keys.view(np.uint64), words.view(np.uint64), does, shared.value.distance)
        return pa.table({"x": shared.value.restored(x).view(np.int64), "y": shared.value.restored(y).view(np.int64)})

    sent = distinct.select("fingerprint").mapInArrow(send, "region int, key bigint, word bigint, does tinyint")
    found = written(sent.groupBy("region").applyInArrow(meet, "x bigint, y bigint"), "links")
    shared.destroy()
    return found


def near_duplicates(docs: DataFrame, distance: int = 3, size: int = 3, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links reach, itself included)."""
    marked = written(fingerprints(docs, size), "fingerprints")
    distinct = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    found = links(distinct, distance, parts)
    least = distinct
    if found is not None and not found.isEmpty():
        linked = components(found).join(distinct, F.col("node") == F.col("fingerprint")).select("node", "component", "first")
        ids = linked.groupBy("component").agg(F.min("first").alias("least"))
        least = linked.join(ids, "component").select(F.col("node").alias("fingerprint"), "least")
        least = distinct.join(least, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("first"))
    hexadecimal = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return marked.join(least, "fingerprint").select("doc_id", hexadecimal.alias("fingerprint"), F.col("first").alias("component_id"))
