"""Repair of conversation structure by dynamic programming over a grammar of role and fault sequences.

Rows of a conversation are put in order and each becomes a symbol: what its first fault demands and
what initial its role has. The cheapest edits that make the role initials match ``(s?(ua)+)?`` are a
product of min-plus matrices, one per symbol, over four states (nothing yet, after s, after u, after
a); an entry holds the cost and the audit, the edits' initials, as a rope. An audit and its first state
fix every role, so among equal costs the least audit decides and products may be taken in any order.

Sequences are compressed by Re-Pair over all conversations: rounds count the adjacent pairs of all
distinct sequences in Spark, weighted by how many conversations have them, and turn the most frequent
pairs, at most ``PAIRS`` a round that cannot overlap, into rules, until no pair occurs twice or after
``ROUNDS`` rounds. Each rule's matrix is made once, bottom-up, from its two parts and serves all
conversations. Pairs left over cost a product more, nothing else.

Order: turn (nulls first), then role, then the SHA-256 of the text; rows equal in all of these are
copies. Nothing gathers a conversation in one task: rows are sorted by range, tasks cut what they hold
of a conversation into sequences of at most ``CHUNK`` symbols, and the matrices and counts of such
pieces are joined ``FAN`` at a time, level by level. Repeated rows are counted before they are shuffled.
Only the digest of a repaired conversation is sequential by nature; its text streams through one task,
a batch at a time, behind the audit.

Null roles and texts are one space, so are nulls in the key of the damage. A null conv_id is a
conversation of its own. Empty roles have no initial; a pair with them is illegal. Faults: blank (no
visible character), duplicate (role and text seen earlier), truncated (last visible character none of
``.!?``). Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codequarry.llm.common import map_batches, slices
from codequarry.sources.storage import written

# Symbols of a sequence at most; pieces joined at a time; rules of a round at most; rounds at most.
CHUNK, FAN, PAIRS, ROUNDS = 4096, 64, 64, 24
# Bytes that a task remembers of matrices, about; what one takes besides its audits.
REMEMBERED, EACH = 64_000_000, 5_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
UNSEEN = " \t\n\u000b\f\r"
#: Symbols: a row that has to go, else its role's initial, in upper case if its text is truncated.
GONE, OTHER = "-", "x"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
INF = float("inf")


# --- audits and matrices -------------------------------------------------------------------------


class Rope:
    """A text made of two others, joined only when it is read."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, left: Rope | None, right: Rope | None, text: str | None = None):
        self.left, self.right, self._text = left, right, text

    def __str__(self) -> str:
        if self._text is None:
            parts, stack = [], [self]
            while stack:
                rope = stack.pop()
                if rope._text is not None:
                    parts.append(rope._text)
                else:
                    stack += [rope.right, rope.left]
            self._text, self.left, self.right = "".join(parts), None, None
        return self._text


Entry = tuple[float, Rope | None]
Matrix = tuple[tuple[Entry, ...], ...]
NEVER: Entry = (INF, None)


def _better(a: Entry, b: Entry) -> Entry:
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[0] == INF or str(a[1]) <= str(b[1]) else b


def product(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest ways through ``a`` and then ``b``; ties to the least audit."""
    rows = []
    for i in STATES:
        row = []
        for j in STATES:
            best = NEVER
            for m in STATES:
                cost = a[i][m][0] + b[m][j][0]
                if cost < INF and cost <= best[0]:
                    best = _better((cost, Rope(a[i][m][1], b[m][j][1])), best)
            row.append(best)
        rows.append(tuple(row))
    return tuple(rows)


def _matrix(ways: list[tuple[int, int, float, str]]) -> Matrix:
    cells = [[NEVER] * 4 for _ in STATES]
    for i, j, cost, audit in ways:
        cells[i][j] = _better((cost, Rope(None, None, audit)), cells[i][j])
    return tuple(map(tuple, cells))


#: Where a state goes when a user or an assistant comes.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: No insertion, one, or two; more lead back to a state that was there before.
INSERTED = _matrix(
    [(i, i, 0, "") for i in STATES] + [(i, NEXT[i], INSERT, "I") for i in STATES] + [(i, NEXT[NEXT[i]], 2 * INSERT, "II") for i in STATES]
)


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions before a row, and the row itself."""
    ways: list[tuple[int, int, float, str]] = [(i, i, DELETE, "D") for i in STATES]
    if symbol != GONE:
        more, initial = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        ways += [(i, NEXT[i], REROLE + more, "R") for i in STATES]
        if initial == "s":
            ways.append((START, SYSTEM, KEEP + more, "K"))
        ways += [(i, NEXT[i], KEEP + more, "K") for i in STATES if initial == ("a" if i == USER else "u")]
    return product(INSERTED, _matrix(ways))


def closed(row: tuple[Entry, ...]) -> Entry:
    """The cheapest end from a row of a matrix: insertions after the last row, and no open exchange."""
    best = NEVER
    for m in STATES:
        for end in (START, ASSISTANT):
            cost = row[m][0] + INSERTED[m][end][0]
            if cost < INF and cost <= best[0]:
                best = _better((cost, Rope(row[m][1], INSERTED[m][end][1])), best)
    return best


UNIT = _matrix([(i, i, 0, "") for i in STATES])
SYMBOLS = {s: symbol_matrix(s) for s in (GONE, *"suaSUA", OTHER, OTHER.upper())}


# --- the grammar ---------------------------------------------------------------------------------


@dataclass
class Grammar:
    """Rounds of rules: each maps pairs of symbols (letters or rule numbers) to a new number."""

    rounds: list[dict[tuple, int]] = field(default_factory=list)

    def size(self) -> int:
        return sum(map(len, self.rounds))

    def compressed(self, sequence: list) -> list:
        for rules in self.rounds:
            sequence = replaced(sequence, rules)
        return sequence

    def matrices(self) -> dict:
        """The matrix of every letter and rule, bottom-up."""
        made = dict(SYMBOLS)
        for rules in self.rounds:
            for (x, y), number in sorted(rules.items(), key=lambda r: r[1]):
                made[number] = product(made[x], made[y])
        return made


def replaced(sequence: list, rules: dict[tuple, int]) -> list:
    """The sequence with the pairs of ``rules`` replaced, from left to right."""
    out, i = [], 0
    while i < len(sequence):
        number = rules.get((sequence[i], sequence[i + 1])) if i + 1 < len(sequence) else None
        out.append(sequence[i] if number is None else number)
        i += 1 if number is None else 2
    return out


def pairs(sequence: list) -> Counter:
    """Adjacent pairs; in a run of one symbol only those that do not overlap."""
    found: Counter = Counter()
    free = True
    for i in range(len(sequence) - 1):
        if free or sequence[i] != sequence[i + 1] or sequence[i - 1] != sequence[i]:
            found[sequence[i], sequence[i + 1]] += 1
            free = sequence[i] != sequence[i + 1]
        else:
            free = True
    return found


def chosen(counts: list[tuple[tuple, int]], most: int) -> list[tuple]:
    """The most frequent pairs of which no two can overlap."""
    lefts, rights, taken = set(), set(), []
    for (x, y), n in sorted(counts, key=lambda c: (-c[1], str(c[0]))):
        if n > 1 and len(taken) < most and x not in rights and y not in lefts and (x != y or x not in lefts and y not in rights):
            taken.append((x, y))
            lefts.add(x)
            rights.add(y)
    return taken


def _symbol(word: str) -> str | int:
    return int(word) if word.isdigit() else word


def learn(sequences: DataFrame, most: int = PAIRS, rounds: int = ROUNDS) -> Grammar:
    """A grammar of the column ``symbols``; every sequence counts as often as it is there.

    The driver holds the rules, at most ``most`` a round, and the ``8 * most`` most frequent pairs.
    """
    grammar = Grammar()
    told = written(sequences.groupBy("symbols").agg(F.count("*").alias("n")), "sequences")
    number = 0
    for _ in range(rounds):

        def count(columns: dict[str, list], grammar: Grammar = grammar) -> dict[str, list]:
            found: Counter = Counter()
            for symbols, n in zip(columns["symbols"], columns["n"]):
                for pair, times in pairs(grammar.compressed(list(symbols))).items():
                    found[pair] += n * times
            return {"x": [str(x) for x, _ in found], "y": [str(y) for _, y in found], "n": list(found.values())}

        counts = map_batches(told, count, "x string, y string, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n"))
        top = counts.filter("n > 1").orderBy(F.desc("n"), "x", "y").limit(8 * most).collect()
        rules = chosen([((_symbol(r.x), _symbol(r.y)), r.n) for r in top], most)
        if not rules:
            break
        grammar = Grammar([*grammar.rounds, {pair: number + i for i, pair in enumerate(rules)}])
        number += len(rules)
    return grammar


# --- rows ----------------------------------------------------------------------------------------


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the row's key draws."""
    draw = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), draw.alias("draw")
    ).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(F.col(column), 256))


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, digest) with their number, ``initial``, ``fault`` and whether role and text came earlier."""
    end = F.right(F.rtrim("text", F.lit(UNSEEN)), F.lit(1))
    fault = F.when(end == "", "blank").when(end.isin(".", "!", "?"), "none").otherwise("truncated")
    short = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), fault.alias("fault"))
    distinct = written(short.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("fault").alias("fault")), "rows")
    rank = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = distinct.groupBy("conv_id", "role", "digest").agg(F.min(rank).alias("first"), F.count("*").alias("places")).filter("places > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return distinct.join(first, same, "left").select(
        "conv_id", "turn", "role", "digest", "n", "fault", F.left("role", F.lit(1)).alias("initial"), seen.alias("seen")
    )


#: What a piece of a conversation knows of itself; pieces next to each other are joined by ``joined``.
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
EDGES = ["first_initial", "last_initial", "first_turn", "last_turn"]
PIECE = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint"
LEGAL = {"su", "ua", "au"}


def joined(a: dict, b: dict) -> dict:
    """Counts and edges of two pieces in order; turns are sorted, so equal ones meet at the edge."""
    out = {c: a[c] + b[c] for c in COUNTS}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    first = a["first_turn"] if a["first_turn"] is not None else b["first_turn"]
    last = b["last_turn"] if b["last_turn"] is not None else a["last_turn"]
    return out | {"first_initial": a["first_initial"], "last_initial": b["last_initial"], "first_turn": first, "last_turn": last}


def _row(turn: int | None, initial: str, symbol: str, fault: str) -> tuple[dict, str]:
    counts = dict.fromkeys(COUNTS, 0)
    if fault != "none":
        counts[fault] = 1
    counts["turns"] = int(turn is not None)
    return counts | {"first_initial": initial, "last_initial": initial, "first_turn": turn, "last_turn": turn}, symbol


def _symbols_of(turn: int | None, initial: str, n: int, fault: str, seen: bool) -> Iterator[tuple[dict, str]]:
    """The rows that a distinct row with ``n`` copies stands for."""
    first = "duplicate" if seen and fault != "blank" else fault
    letter = initial if initial and initial in "sua" else OTHER
    symbol = {"blank": GONE, "duplicate": GONE, "truncated": letter.upper(), "none": letter}[first]
    yield _row(turn, initial, symbol, first)
    again = fault if fault == "blank" else "duplicate"
    for _ in range(n - 1):
        yield _row(turn, initial, GONE, again)


def sequences(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, place, symbols and what a piece knows: each task's part of a conversation, in pieces of at most ``chunk`` rows.

    ``place`` orders the pieces of a conversation. ``rows`` are those of ``marked``; hand in a written table.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place bigint, symbols string, {PIECE}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, conv, piece, symbols = TaskContext.get().partitionId() << 40, None, None, []
        out: list[dict] = []

        def end() -> None:
            nonlocal place, piece, symbols
            if piece is not None:
                out.append({"conv_id": conv, "place": place, "symbols": "".join(symbols)} | piece)
                place, piece, symbols = place + 1, None, []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            return batch

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "n", "fault", "seen")]
            for this, turn, initial, n, fault, seen in zip(*columns):
                if this != conv:
                    end()
                    conv = this
                for counts, symbol in _symbols_of(turn, initial, n, fault, seen):
                    piece = counts if piece is None else joined(piece, counts)
                    symbols.append(symbol)
                    if len(symbols) >= chunk:
                        end()
                if len(out) >= 1000:
                    yield flushed()
            if out:
                yield flushed()
        end()
        yield flushed()

    return placed.select("conv_id", "turn", "initial", "n", "fault", "seen").mapInArrow(cut, schema)


# --- solving -------------------------------------------------------------------------------------

MATRIX = "matrix array<struct<cost: double, audit: string>>"


def _stored(matrix: Matrix) -> list[dict | None]:
    return [None if cost == INF else {"cost": cost, "audit": str(rope)} for row in matrix for cost, rope in row]


def _loaded(cells: list[dict | None]) -> Matrix:
    entries = [NEVER if c is None else (c["cost"], Rope(None, None, c["audit"])) for c in cells]
    return tuple(tuple(entries[4 * i : 4 * i + 4]) for i in STATES)


def solved(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """``pieces`` with the matrix of their sequence instead of the sequence."""
    state: dict = {}

    def solve(columns: dict[str, list]) -> dict[str, list]:
        if not state:
            state.update(rules=grammar.matrices(), known={}, size=0)
        rules, known = state["rules"], state["known"]
        out = []
        for symbols in columns["symbols"]:
            if symbols not in known:
                if state["size"] >= REMEMBERED:
                    known.clear()
                    state["size"] = 0
                state["size"] += EACH + 16 * len(symbols)
                whole = UNIT
                for part in grammar.compressed(list(symbols)):
                    whole = product(whole, rules[part])
                known[symbols] = _stored(whole)
            out.append(known[symbols])
        return columns | {"matrix": out}

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return map_batches(pieces, solve, f"conv_id {kind}, place bigint, {PIECE}, {MATRIX}", finish=state.clear)


def whole(pieces: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per conversation: pieces of those that have several are joined ``fan`` at a time."""
    schema, arrow = pieces.schema, to_arrow_schema(pieces.schema)
    result = None
    while True:
        several = pieces.groupBy("conv_id").agg(F.count("*").alias("pieces")).filter("pieces > 1").select(F.col("conv_id").alias("c"))
        several = written(several, "several")
        same = F.col("conv_id").eqNullSafe(F.col("c"))
        done = pieces.join(several, same, "left_anti")
        result = done if result is None else result.unionByName(done)
        if several.isEmpty():
            return result
        open_ = _numbered(pieces.join(several, same, "left_semi"))

        def join(key: tuple, group: pa.Table) -> pa.Table:
            rows = sorted(group.to_pylist(), key=lambda r: r["place"])
            total = rows[0] | {"matrix": _loaded(rows[0]["matrix"])}
            for row in rows[1:]:
                total = total | joined(total, row) | {"matrix": product(total["matrix"], _loaded(row["matrix"]))}
            total["matrix"] = _stored(total["matrix"])
            total["place"] = key[1].as_py()
            return pa.Table.from_pylist([{f: total[f] for f in arrow.names}], schema=arrow)

        grouped = open_.withColumn("group", F.floor(F.col("number") / fan)).groupBy("conv_id", "group")
        pieces = written(grouped.applyInArrow(join, schema), "joined")


def _numbered(pieces: DataFrame) -> DataFrame:
    """``number``: the place of each piece among those of its conversation, from 0.

    Places are task numbers with counters, so counting by task first gives the numbers without
    gathering a conversation.
    """
    task = F.shiftright("place", 40)
    counts = pieces.groupBy("conv_id", task.alias("t")).agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("t").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("conv_id").alias("c"), "t", "low", F.coalesce(before, F.lit(0)).alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (task == F.col("t"))
    return pieces.join(starts, same).withColumn("number", F.col("before") + F.col("place") - F.col("low")).select(*pieces.columns, "number")


def answers(joined_pieces: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of whole conversations."""
    counts = ["blank", "duplicate", "truncated", "illegal"]

    def answer(columns: dict[str, list]) -> dict[str, list]:
        ends = [closed(_loaded(m)[START]) for m in columns["matrix"]]
        gaps = [0 if a is None else b - a + 1 - n for a, b, n in zip(columns["first_turn"], columns["last_turn"], columns["turns"])]
        picked = {c: columns[c] for c in ["conv_id", *counts]}
        return picked | {"gaps": gaps, "cost": [int(c) for c, _ in ends], "audit": [str(a) for _, a in ends]}

    kind = joined_pieces.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in ("gaps", *counts, "cost"))
    return map_batches(joined_pieces, answer, f"conv_id {kind}, {longs}, audit string")


ROLES = {USER: "user", ASSISTANT: "assistant"}


class Repair:
    """The digest of one repaired conversation, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.hash = audit, 0, START, True, hashlib.sha256()

    def _add(self, role: str, text: str) -> None:
        self.hash.update((f"{role}:{text}" if self.first else f"\n{role}:{text}").encode())
        self.first = False

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._add(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.state = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[self.state]
            self._add(role if edit == "K" else ROLES[self.state], text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def with_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the digest of each repaired conversation.

    ``found`` has conv_id and audit, each conv_id once; ``rows`` have conv_id, turn, role, text. Texts
    are shuffled once and stream past the audit of their conversation.
    """
    schema = StructType([*found.schema.fields]).add("repaired_sha256", "string")
    arrow = to_arrow_schema(schema)
    heads = found.select("conv_id", F.struct(*[c for c in found.columns if c != "conv_id"]).alias("head"))
    texts = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), "text")
    both = heads.unionByName(texts, allowMissingColumns=True).withColumn("follows", F.col("head").isNull())
    order = ["conv_id", "follows", "turn", "role", "digest"]
    placed = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "head", "role", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now, repair = None, None

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            return batch

        for batch in slices(batches):
            for conv, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text"))):
                if head is None:
                    repair.row(role, text)
                    continue
                if repair is not None:
                    out.append(now | {"repaired_sha256": repair.digest()})
                now, repair = {"conv_id": conv} | head, Repair(head["audit"])
            yield flushed()
        if repair is not None:
            out.append(now | {"repaired_sha256": repair.digest()})
        yield flushed()

    return placed.mapInArrow(stream, schema)


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(rows: DataFrame, ids: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation in ``ids`` (conv_id), from its ``rows`` (conv_id, turn, role, text).

    A conversation without rows: zeros, an empty audit, the digest of an empty text.
    """
    pieces = written(sequences(written(marked(rows), "marked"), chunk), "pieces")
    known = answers(whole(written(solved(pieces, learn(pieces)), "solved"), fan)).withColumnRenamed("conv_id", "c")
    found = ids.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return with_digests(rows, found.na.fill({"audit": "", **dict.fromkeys(RESULT[1:7], 0)})).select(RESULT)
