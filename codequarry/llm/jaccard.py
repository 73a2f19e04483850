"""Jaccard join in metric space: pivots, regions, windows.

1 - Jaccard similarity is a metric. Two texts link when their distance is at most ``delta``.

Regions. Unrelated texts are all at distance 1, so plain pivots would leave one region with nearly
everything. Hence each shingle is a pivot first: of all shingles of a text it is nearest to the rarest ones.
A text of n shingles that links with another shares one of its n - ceil((1 - delta) n) + 1 first
shingles with it, in any fixed order (rarest first here); these are its regions. Texts with equal
sets are one class. The smallest id of a shingle's region becomes its document pivot, and shingles
with the same pivot make one region. The distance of every member to its pivot is computed exactly.

Sketches. Each set is also counted into hash buckets, a sixteenth as many as shingles. What two sets
differ by in the buckets is a lower bound of what they differ by at all (triangle inequality again),
so most pairs of a member and its pivot, and most members of a region, are told apart by a few bytes
instead of their sets. The longer of two sketches folds to the length of the shorter.

Windows. Members within ``delta`` of their pivot link with it, and need no comparison among
themselves: they are one component. A region whose members are all in one component is done; of the
others the members stay that could link, by sketch, with a member of another component. Two members
can only link if their distances to the pivot differ by ``delta`` at most. So a region is cut into
rings of this width, and each ring also gets the members of the ring inside it.

Joining. In rings with several components, the members outside the largest one are held against all
members, by an inverted list of the ring's shingles, in blocks of bounded size: a large ring is many
tasks. Only links that connect two components leave a task, so a group of copies or near copies
never becomes pairs.

Order of shingles: counts of 2^20 hash slots over all texts (4 MB, broadcast until the regions are
written). Tables that grow with the input meet by merge joins at every size, so the driver holds
none of them.
A text without words, or null, has no shingles and links with nothing. A text with fewer words than
a shingle has one shingle, all its words. Shingles are 64-bit hashes, sets are told apart by 128.
Repeated rows of an id are one node, copies or not; a row without an id has the component of its
copies with one, or none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import broadcast_if_small, free_name, map_batches, slices
from codequarry.llm.components import components
from codequarry.sources.storage import written

SLOT_BITS = 20
BUCKETS = 128  # of a sketch at least
CHUNK = 1 << 16  # slots that travel in one row
QUERIES, MEMBERS = 512, 4096  # members of a ring that meet in one task
_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class WordHashes(dict):
    """Hashes of words, remembered within a task up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _SEED[0]
    x = (x ^ (x >> np.uint64(29))) * _SEED[1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, known: WordHashes, size: int = 3) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted.

    Bytes are lower-cased and split as ASCII only, like the contracted words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = mixed(h * _SEED[2] + w[i:len(w) - n + 1 + i])
    return np.unique(h)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Shingles per bucket, up to 255; a power of two of buckets, so that sketches fold."""
    buckets = max(BUCKETS, 1 << int(len(shingles) // 16).bit_length())
    return np.minimum(np.bincount((shingles & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def _folded_to(sketches: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of sketches with as many buckets or fewer."""
    if sketches.shape[1] == buckets:
        return sketches.astype(np.int16)
    return sketches.reshape(len(sketches), -1, buckets).sum(axis=1, dtype=np.int32)


def describe(docs: DataFrame, size: int = 3) -> DataFrame:
    """One pass over the texts, written: rows of documents (doc_id, n_shingles, set_a, set_b, and
    the sketch in counts), and per task rows of slot counts (chunk, counts)."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordHashes(), np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in slices(batches):
            n, a, b, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, known, size)
                n.append(len(s))
                a.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mixed(s ^ _SEED[3]).sum(dtype=np.uint64).view(np.int64)))
                sketches.append(sketch(s).tobytes())
                np.add.at(counts, _slots(s), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(n), pa.int32()), pa.array(sketches, pa.binary())], schema=schema
            )
        for chunk in range(len(counts) // CHUNK):
            part = counts[chunk * CHUNK:(chunk + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(1, pa.int64())] * 4, pa.array([chunk], pa.int32()), pa.array([np.minimum(part, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], schema=schema
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(
        rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, chunk int, counts binary"), "sets"
    )


def _added(rows: DataFrame, kind: type, *keys: str) -> DataFrame:
    """Add up slot counts as they stream through tasks that are dealt by ``keys``; as 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[chunk] = held.get(chunk, 0) + np.frombuffer(counts, dtype=kind).astype(np.int64)
        for chunk, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["chunk", "counts"])

    return rows.repartition(*keys).select("chunk", "counts").mapInArrow(run, "chunk int, counts binary")


def slot_order(described: DataFrame) -> np.ndarray:
    """Counts of all slots: a fixed 2^20 numbers, whatever the input."""
    rows = described.filter(F.col("chunk").isNotNull()).select("chunk", "counts")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(64)))
    got = _added(_added(dealt, np.int32, "chunk", "salt"), np.int64, "chunk").toArrow()
    order = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for chunk, counts in zip(got.column("chunk").to_pylist(), got.column("counts").to_pylist()):
        order[chunk * CHUNK:(chunk + 1) * CHUNK] += np.frombuffer(counts, dtype=np.int64)
    return np.minimum(order, np.iinfo(np.uint32).max).astype(np.uint32)


def regions(docs: DataFrame, shared: Broadcast, percent: int = 90, size: int = 3) -> DataFrame:
    """key, member: the shingle regions of each class, by its smallest id; ``shared`` holds the order of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            ids, keys, classes = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, known, size)
                n = len(s)
                if n and doc_id is not None:
                    first = n + (-percent * n) // 100 + 1
                    keys.append(s[np.lexsort((s, shared.value[_slots(s)]))[:first]])
                    ids.append(np.full(first, doc_id, dtype=np.int64))
                    classes.append(np.full(first, mixed(s).sum(dtype=np.uint64).view(np.int64)))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(classes)), pa.array(np.concatenate(ids))], names=["key", "set_a", "doc_id"]
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "key bigint, set_a bigint, doc_id bigint")
    return rows.groupBy("key", "set_a").agg(F.min("doc_id").alias("member")).select("key", "member")


def document_pivots(shingle_regions: DataFrame) -> DataFrame:
    """member, pivot: every member with the smallest member of each of its regions."""
    rows = written(shingle_regions, "regions")
    heads = rows.groupBy("key").agg(F.min("member").alias("pivot"), F.max("member").alias("last")).filter("pivot < last").select("key", "pivot")
    return rows.join(heads.hint("merge"), "key").filter("member != pivot").select("member", "pivot").distinct()


def class_sets(docs: DataFrame, wanted: DataFrame, size: int = 3) -> DataFrame:
    """member, shingles (sorted hashes as bytes) of the documents named in ``wanted`` (member)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("member"), "text").join(broadcast_if_small(wanted), "member")

    def sets(b):
        known = WordHashes()
        return {"member": b["member"], "shingles": [shingle_set(t, known, size).tobytes() for t in b["text"]]}

    return map_batches(rows, sets, "member bigint, shingles binary")


def _close(x: np.ndarray, n: int, others: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """By sketch: which of ``others`` (rows of sketches of one length) the set of ``x`` could link with.

    A count that was cut off at 255 tells nothing; such a set could link with any.
    """
    buckets = min(len(x), others.shape[1])
    differ = np.abs(_folded_to(x[None, :], buckets) - _folded_to(others, buckets)).sum(axis=1, dtype=np.int64)
    cut = (others == 255).any(axis=1) | bool((x == 255).any())
    return cut | (differ * (100 + percent) <= (n + m) * (100 - percent))


def _sketched(df: DataFrame, described: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    """``df`` with size and sketch of the set of the document in ``column``."""
    known = described.filter(F.col("chunk").isNull()).select(
        F.col("doc_id").alias(column), F.col("n_shingles").alias(names[0]), F.col("counts").alias(names[1])
    )
    return df.join(known.hint("merge"), column)


def plausible(pairs: DataFrame, described: DataFrame, percent: int = 90) -> DataFrame:
    """The rows of ``pairs`` (member, pivot) that could link."""
    rows = _sketched(_sketched(pairs, described, "member", ("n", "x")), described, "pivot", ("m", "y"))

    def close(b):
        rows = zip(b["x"], b["n"], b["y"], b["m"])
        sketches = ((np.frombuffer(x, dtype=np.uint8), n, np.frombuffer(y, dtype=np.uint8)[None, :], np.array([m])) for x, n, y, m in rows)
        near = np.array([bool(_close(*r, percent)[0]) for r in sketches], dtype=bool)
        return {c: np.array(b[c], dtype=np.int64)[near] for c in ("member", "pivot")}

    return map_batches(rows, close, "member bigint, pivot bigint").distinct()


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """member, pivot, common, total (sizes of intersection and union)."""
    others = sets.select(F.col("member").alias("pivot"), F.col("shingles").alias("others"))
    rows = pairs.join(sets.hint("merge"), "member").join(others.hint("merge"), "pivot")

    def measure(b):
        common, total = [], []
        for x, y in zip(b["shingles"], b["others"]):
            a, c = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = np.concatenate([a, c])
            both.sort()
            n = int((both[1:] == both[:-1]).sum())
            common.append(n)
            total.append(len(both) - n)
        return {"member": b["member"], "pivot": b["pivot"], "common": common, "total": total}

    return map_batches(rows, measure, "member bigint, pivot bigint, common bigint, total bigint").distinct()


def _labelled(regions: DataFrame, labels: DataFrame) -> DataFrame:
    return regions.join(labels.select(F.col("node").alias("member"), "component").hint("merge"), "member", "left").withColumn(
        "component", F.coalesce("component", "member")
    )


def _blocks(rows: DataFrame, key: list[str], payload: list[str], queries: int, members: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of each open group in blocks: members outside its largest component, and all
    members. Groups of one component are left out."""
    sizes = rows.groupBy(*key, "component").agg(F.count("*").alias("n"))
    most = sizes.groupBy(*key).agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("parts")
    ).filter("parts > 1")
    plan = most.select(
        *key, "largest", F.ceil(F.col("n") / members).cast("int").alias("m_blocks"),
        F.ceil((F.col("n") - F.col("top")) / queries).cast("int").alias("q_blocks"),
    )
    both = rows.join(plan.hint("merge"), key)
    deal = lambda n: F.pmod(F.xxhash64("member"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["member", "component", *payload]
    asked = both.filter("component != largest").select(*key, deal("q_blocks").alias("q"), each("m_blocks").alias("m"), *columns)
    held = both.select(*key, each("q_blocks").alias("q"), deal("m_blocks").alias("m"), *columns)
    return asked, held.select([F.col(c).alias(c) for c in held.columns])  # columns of their own beside ``asked``


def could_link(pairs: DataFrame, labels: DataFrame, described: DataFrame, percent: int = 90, queries: int = QUERIES, members: int = MEMBERS) -> DataFrame:
    """member, pivot: the members of each region that could link with one of another component."""
    whole = pairs.unionByName(pairs.select(F.col("pivot").alias("member"), "pivot").distinct())
    asked, held = _blocks(_labelled(whole, labels), ["pivot"], [], queries, members)
    asked, held = (_sketched(side, described, "member", ("n", "x")) for side in (asked, held))
    held = held.select([F.col(c).alias(c) for c in held.columns])

    def prune(left: pa.Table, right: pa.Table) -> pa.Table:
        alive: set[int] = set()
        if left.num_rows and right.num_rows:
            x, y = (t.column("x").to_pylist() for t in (left, right))
            (n, ids, own), (m, others, theirs) = ([t.column(c).to_numpy() for c in ("n", "member", "component")] for t in (left, right))
            order = np.argsort(m, kind="stable")
            m, others, theirs, y = m[order], others[order], theirs[order], [y[i] for i in order]
            # sketches grow with their sets, so those of one length stand together
            lengths = np.array([len(s) for s in y])
            starts = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(y)]])
            runs = [
                (lo, hi, np.frombuffer(b"".join(y[lo:hi]), dtype=np.uint8).reshape(hi - lo, -1))
                for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist())
            ]
            for i in range(len(ids)):  # sizes within the threshold, then sketches
                first, last = np.searchsorted(m, [-(-n[i] * percent // 100), n[i] * 100 // percent + 1])
                mine = np.frombuffer(x[i], dtype=np.uint8)
                for lo, hi, block in runs:
                    a, b = max(lo, first), min(hi, last)
                    if a < b:
                        near = _close(mine, int(n[i]), block[a - lo:b - lo], m[a:b], percent) & (theirs[a:b] != own[i])
                        if near.any():
                            alive.add(int(ids[i]))
                            alive.update(others[a:b][near].tolist())
        pivot = (left if left.num_rows else right).column("pivot")[0].as_py()
        return pa.table([pa.array(sorted(alive), pa.int64()), pa.array([pivot] * len(alive), pa.int64())], names=["member", "pivot"])

    keys = ["pivot", "q", "m"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(prune, "member bigint, pivot bigint").distinct()


def rings(measured: DataFrame, pivots: DataFrame, labels: DataFrame, percent: int = 90) -> DataFrame:
    """pivot, ring, member, home, component: the rings that still hold several components.

    Ring r has the members at a distance in [r delta, (r + 1) delta) from the pivot, as home, and
    those of ring r - 1 as guests. ``pivots`` (pivot) take part themselves, in ring 0.
    """
    far = F.col("total") - F.col("common")
    width = F.col("total") * (100 - percent)
    ring = F.floor(far * 100 / width) if percent < 100 else F.when(far > 0, 1).otherwise(0)
    own = measured.select("pivot", "member", ring.cast("int").alias("ring"))
    own = _labelled(own.unionByName(pivots.select("pivot", F.col("pivot").alias("member"), F.lit(0).alias("ring"))), labels)
    both = F.explode(F.array(F.struct(F.lit(0).alias("more"), F.lit(True).alias("home")), F.struct(F.lit(1).alias("more"), F.lit(False).alias("home"))))
    rows = own.select("pivot", "member", "component", "ring", both.alias("b")).select(
        "pivot", (F.col("ring") + F.col("b.more")).alias("ring"), "member", F.col("b.home").alias("home"), "component"
    )
    open_rings = rows.groupBy("pivot", "ring").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.max("home").alias("has_home")
    ).filter("low < high AND has_home").select("pivot", "ring")
    return rows.join(open_rings.hint("merge"), ["pivot", "ring"], "left_semi")


def joined(asked: pa.Table, held: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between ``asked`` and ``held`` members that connect different components."""
    own = [np.frombuffer(s, dtype=np.uint64) for s in held.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in own], dtype=np.int64)
    shingles = np.concatenate(own)
    by_shingle = np.argsort(shingles, kind="stable")
    holder = np.repeat(np.arange(len(own)), sizes)[by_shingle]
    shingles = shingles[by_shingle]
    ids, home = held.column("member").to_pylist(), np.array(held.column("home").to_pylist())
    root = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    labels, found = held.column("component").to_pylist(), []
    for x, x_home, label, data in zip(*(asked.column(c).to_pylist() for c in ("member", "home", "component", "shingles"))):
        s = np.frombuffer(data, dtype=np.uint64)
        low, high = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
        spans = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        common = np.bincount(holder[at], minlength=len(own))
        near = 100 * common >= percent * (len(s) + sizes - common)
        if not x_home:
            near &= home
        for j in np.flatnonzero(near):
            if ids[j] != x and find(label) != find(labels[j]):
                root[find(label)] = find(labels[j])
                found.append((x, ids[j]))
    return found


def ring_links(open_rings: DataFrame, sets: DataFrame, percent: int = 90, queries: int = QUERIES, members: int = MEMBERS) -> DataFrame:
    """x, y: links across components, at most one less than the components of a block."""
    asked, held = _blocks(open_rings, ["pivot", "ring"], ["home"], queries, members)
    asked, held = asked.join(sets.hint("merge"), "member"), held.join(sets.hint("merge"), "member")
    held = held.select([F.col(c).alias(c) for c in held.columns])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        links = joined(left, right, percent) if left.num_rows and right.num_rows else []
        return pa.table([pa.array([l[i] for l in links], pa.int64()) for i in (0, 1)], names=["x", "y"])

    keys = ["pivot", "ring", "q", "m"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(join, "x bigint, y bigint")


def _ends(pairs: DataFrame) -> DataFrame:
    return written(pairs.select("member").unionByName(pairs.select(F.col("pivot").alias("member"))).distinct(), "wanted")


def similar_groups(docs: DataFrame, percent: int = 90, size: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    described = describe(docs, size)
    shared = docs.sparkSession.sparkContext.broadcast(slot_order(described))
    pairs = written(document_pivots(regions(docs, shared, percent, size)), "pairs")
    shared.destroy()
    likely = written(plausible(pairs, described, percent), "plausible")
    measured = distances(likely, written(class_sets(docs, _ends(likely), size), "classes"))
    direct = measured.filter(F.col("common") * 100 >= F.col("total") * percent).select(F.col("member").alias("x"), F.col("pivot").alias("y"))
    labels = components(written(direct, "direct"))
    alive = written(could_link(pairs, labels, described, percent), "alive")
    others = alive.filter("member != pivot")
    sets = written(class_sets(docs, _ends(alive), size), "classes")
    rows = rings(distances(others, sets), alive.filter("member = pivot").select("pivot"), labels, percent)
    across = written(ring_links(written(rows, "rings"), sets, percent), "across")
    labels = components(labels.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(across))
    rows = described.filter(F.col("chunk").isNull()).select("doc_id", "n_shingles", "set_a", "set_b")
    classes = rows.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"))
    classes = classes.join(labels.hint("merge"), "node", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    named = rows.join(classes.hint("merge"), ["set_a", "set_b", "n_shingles"], "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns kept."""
    firsts = groups.filter((F.col("component_id") == F.col("doc_id")) | F.col("doc_id").isNull())
    first = free_name(docs, "first")
    keep = firsts.select(F.col("doc_id").alias(first)).distinct()
    return docs.join(keep, F.col("doc_id").cast("bigint").eqNullSafe(F.col(first)), "left_semi")
