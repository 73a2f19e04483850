"""Declarations of source files by brace matching.

One shuffle places each file by path. A file is cut at its braces and semicolons, and the braces
are matched, by counts over the texts of a whole batch; the patterns then read each piece by itself.
Nothing is sorted, and no row is moved twice.
"""

from __future__ import annotations

import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import java
from codequarry.functions.text import SPACES
from codequarry.plans.placement import place

TYPE_KINDS = ["class", "interface", "enum", "record"]
SCOPE_KINDS = TYPE_KINDS + ["anonymous"]
MARKS = re.compile("([{};])")
# A quote that closes nothing is blanked as well.
HIDDEN = re.compile(java.HIDDEN + r"""|["']""")
OWN = ["pos", "level", "start", "mark_end", "end", "close_pos", "has", "mark", "text"]
CUT = (
    "parent_id int, parent_start int, parent_text string, held array<struct<"
    "pos int, level int, start int, mark_end int, end int, close_pos int, has int, mark string, text string>>"
)
# What a piece has, as bits: so most patterns need not look at its text. ODD pieces are not plain as they are.
ANNOTATED, ANGLED, BLANKS, ROUND, EQUALS, DOTTED = (1 << i for i in range(6))
ODD = ANNOTATED | ANGLED | BLANKS


def _table(of: dict[str, int]) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for chars, value in of.items():
        table[list(chars.encode())] = value
    return table


OPEN, CLOSE, STOP = 1, 2, 3
MARK_OF = _table({"{": OPEN, "}": CLOSE, ";": STOP})
IS_SPACE = _table({SPACES: 1})
HAS = _table({"@": ANNOTATED, "<": ANGLED, SPACES.replace(" ", ""): BLANKS, "(": ROUND, "=": EQUALS, ".": DOTTED})


def _shown(code: str) -> str:
    """Code with blanks for its comments and literals."""
    return HIDDEN.sub(lambda m: " " * len(m[0]), code)


def _merged(contents: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """Files of one path, read as one, piece by piece; the number of each piece in its file, and the file's length."""
    found = []
    for content in contents:
        cut = MARKS.split(content)
        found += [(i, before + mark, len(content)) for i, (before, mark) in enumerate(zip(cut[::2], cut[1::2]))]
    found.sort(key=lambda piece: piece[0])
    return "".join(shown for _, shown, _ in found), [(i, n) for i, _, n in found]


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def _pieces(files: pa.Array) -> pa.Array:
    """Per file its blocks, each with the text before each brace and semicolon directly in it.

    What stands outside of all blocks comes without a parent. Pieces that hold nothing are left out.
    Files of one path are read as one, piece by piece.
    """
    several, texts = {}, []
    for contents in files.to_pylist():
        if len(contents) != 1:
            several[len(texts)] = _merged(contents)
        texts.append(several[len(texts)][0] if len(contents) != 1 else contents[0])
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw], dtype=np.int64)]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    kinds = MARK_OF[data]
    at = np.flatnonzero(kinds)
    kind, file = kinds[at], np.searchsorted(offsets, at, "right") - 1
    n, number = len(at), np.arange(len(at))
    head = np.searchsorted(at, offsets[:-1])
    pos = number - head[file]
    first_of_file = pos == 0

    def before(now: np.ndarray, start) -> np.ndarray:
        """What the mark before has, or ``start``."""
        return np.where(first_of_file, start, np.concatenate([[0], now[:-1]]) if n else now)

    # depth counts all braces; height only those that closed something, as a stack would hold them
    step = (kind == OPEN).astype(np.int64) - (kind == CLOSE)
    total = np.cumsum(step)
    depth = total - np.concatenate([[0], total])[head[file]]
    apart = file * (2 * n + 2)
    height = depth - (np.minimum.accumulate(np.minimum(depth, 0) - apart) + apart)
    height_before = before(height, 0)
    around = np.where(kind == CLOSE, height, height_before)
    level = np.where(kind == CLOSE, depth, depth - step)

    # the brace that is open at some height is the last one before that opened there
    key = lambda some, high: (file[some] * (n + 2) + high) * (n + 1) + number[some]
    opens = np.flatnonzero(kind == OPEN)
    keys = key(opens, height_before[opens])
    order = np.argsort(keys)
    last_open = lambda some, high: opens[order[np.searchsorted(keys[order], key(some, high)) - 1]]
    closers, held = np.flatnonzero((kind == CLOSE) & (height_before > 0)), np.flatnonzero(around > 0)
    closed_by, parent = np.full(n, -1), np.full(n, -1)
    closed_by[last_open(closers, height[closers])] = closers
    parent[held] = last_open(held, around[held] - 1)

    solid, dots = np.flatnonzero(IS_SPACE[data] == 0), np.flatnonzero(data == ord("."))
    begin = solid[np.searchsorted(solid, before(at + 1, offsets[file]))] if n else at
    dotted = np.searchsorted(dots, at) > np.searchsorted(dots, begin)
    kept = np.flatnonzero((kind == OPEN) | np.where(kind == STOP, begin < at, dotted))
    if len(data) and data.max() > 127:
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        origin, begin_at, mark_at = chars[offsets], chars[begin], chars[at]
    else:
        origin, begin_at, mark_at = offsets, begin, at
    start, mark_end, file_end = begin_at - origin[file], mark_at - origin[file] + 1, (origin[1:] - origin[:-1])[file]
    for f, (_, given) in several.items():
        for i, (own, length) in enumerate(given, head[f]):
            pos[i], file_end[i] = own, length
    end = np.where(kind == OPEN, np.where(closed_by >= 0, mark_end[closed_by], file_end), mark_end) if n else mark_end

    edge = np.zeros(len(data) + 1, np.int8)
    edge[begin[kept]] += 1
    edge[at[kept]] -= 1
    shown, lengths = data[np.cumsum(edge[:-1]).astype(bool)], (at - begin)[kept]
    text = _strings(shown, lengths)
    bits = np.append(HAS[shown], np.uint8(0))
    if len(shown) > 1:
        bits[:-2][(shown[:-1] == 32) & (shown[1:] == 32)] |= BLANKS
    has = np.zeros(len(kept), np.int32)
    if len(kept):
        has = np.where(lengths > 0, np.bitwise_or.reduceat(bits, np.cumsum(lengths) - lengths), 0).astype(np.int32)

    whole = lambda x: pa.array(x[kept].astype(np.int32))
    close_pos = pa.array(np.where(closed_by >= 0, pos[closed_by], 0)[kept].astype(np.int32), mask=closed_by[kept] < 0) if n else whole(pos)
    marks = pa.array(["{", "}", ";"]).take(pa.array(kind[kept].astype(np.int32) - 1))
    own = [whole(pos), whole(level), whole(start), whole(mark_end), whole(end), close_pos, pa.array(has), marks, text]
    # pieces of one block beside each other, in order
    by_block = np.lexsort((parent[kept], file[kept]))
    block, of_file = parent[kept][by_block], file[kept][by_block]
    fresh = np.ones(len(kept), bool)
    fresh[1:] = (block[1:] != block[:-1]) | (of_file[1:] != of_file[:-1])
    first = np.flatnonzero(fresh)
    row_of = np.zeros(n, np.int32)
    row_of[kept] = np.arange(len(kept))
    has_parent = block[first] >= 0
    given = pa.array(row_of[block[first]] if n else row_of, mask=~has_parent)
    handed = [own[OWN.index(c)].take(given) for c in ("pos", "start", "text")]
    inner = pa.StructArray.from_arrays(own, names=OWN).take(pa.array(by_block))
    listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(kept)).astype(np.int32)), inner)
    blocks = pa.StructArray.from_arrays([*handed, listed], names=["parent_id", "parent_start", "parent_text", "held"])
    ends = np.searchsorted(of_file[first], np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), blocks)


def _cut(codes: pa.Array) -> pa.Array:
    """The pieces of files given as lists of (code, whether it is blanked already)."""
    shown = [[c["code"] if c["blank"] else _shown(c["code"]) for c in file if c["code"] is not None] for file in codes.to_pylist()]
    return _pieces(pa.array(shown, pa.list_(pa.string())))


def _scope_kind(plain: Column) -> Column:
    """What a block header opens, as far as the header alone tells."""
    typed = plain.contains("class") | plain.contains("interface") | plain.contains("enum") | plain.contains("record")
    kind = F.when(typed, F.nullif(F.regexp_extract(plain, java.TYPE_HEADER, 1), F.lit("")))
    anonymous = F.when(plain.contains("new") & plain.contains("("), plain.rlike(java.ANONYMOUS_HEADER))
    return F.coalesce(kind, F.when(anonymous, F.lit("anonymous")))


def _type_name(kind: Column, plain: Column) -> Column:
    return F.when(kind != "anonymous", F.regexp_extract(plain, java.TYPE_HEADER, 2))


def _both(text: Column, pattern: str, first: int, second: int) -> Column:
    """Two groups of a pattern that holds for the whole text, in one search; null without a match.

    The text has no line breaks.
    """
    shown = F.regexp_replace(text, pattern, f"\n${first}\n${second}")
    return F.when(shown.startswith("\n"), F.split(shown, "\n"))


def _has(bit: int) -> Column:
    return F.col("has").bitwiseAND(F.lit(bit)) != 0


def pieces(files: DataFrame, kinds: Collection[str] | None = None, sources: bool = False) -> DataFrame:
    """One row per brace or semicolon with what the text before it reads as.

    With ``kinds``, patterns that only tell other kinds are not searched. With ``sources``, rows
    come with the contents of the files of their path.
    """
    wants = lambda *some: kinds is None or not set(kinds).isdisjoint(some)
    content = F.col("content")
    # the patterns of annotations are Java's; most files have none
    marked = content.contains("@")
    code = F.struct(F.when(marked, java.blank_hidden(content)).otherwise(F.make_valid_utf8(content)).alias("code"), marked.alias("blank"))
    placed = place(files.select("path", "content"), "path")
    if sources:
        listed = placed.filter("path IS NOT NULL").groupBy("path").agg(F.collect_list(F.struct("content")).alias("sources"))
        codes = F.transform("sources", lambda x: x["content"])
        each = lambda c: F.struct(
            F.when(c.contains("@"), java.blank_hidden(c)).otherwise(F.make_valid_utf8(c)).alias("code"), c.contains("@").alias("blank")
        )
        listed = listed.select("path", "sources", F.transform(F.array_compact(codes), each).alias("codes"))
    else:
        listed = placed.filter("content IS NOT NULL").groupBy("path").agg(F.collect_list(code).alias("codes"))
    carried = ["path", "sources"] if sources else ["path"]
    cut = listed.select(*carried, F.inline(F.arrow_udf(_cut, f"array<struct<{CUT}>>")("codes")))
    # a block's header is read once, not once for each piece in it
    parent = F.struct(_scope_kind(F.col("parent_plain")).alias("opens"), F.col("parent_plain").alias("plain"))
    around = (
        cut.withColumn("parent_plain", F.when(F.col("parent_id").isNotNull(), java.plain_header(F.col("parent_text"))))
        .withColumn("parent", parent)
        .withColumn("parent_kind", F.when(F.col("parent_id").isNotNull(), F.coalesce("parent.opens", F.lit("other"))))
        .withColumn("parent_name", _type_name(F.col("parent.opens"), F.col("parent.plain")))
    )
    cut = around.select(*carried, "parent_id", "parent_start", "parent_kind", "parent_name", F.inline("held"))
    text, plain, left = F.col("text"), F.col("plain"), F.col("left_side")
    is_block, statement, closes = F.col("mark") == "{", F.col("mark") == ";", F.col("mark") == "}"
    in_scope, outside = F.col("parent_kind").isin(SCOPE_KINDS), F.col("parent_id").isNull()
    # what can be neither a declaration nor hold a call is left out before it is searched
    members = is_block if not wants("package", "import", "method", "constructor", "field") else is_block | in_scope | outside
    cut = cut.filter(members | (_has(DOTTED) & _has(ROUND)) if kinds is None else members)
    # No name holds a point or a bracket, so one search finds both names of a call.
    calls = F.transform(
        F.regexp_extract_all("text", F.lit(java.CALL), F.lit(0)),
        lambda c: F.struct(
            F.substring_index(c, ".", 1).alias("receiver"),
            F.substring_index(F.substring_index(c, ".", -1), "(", 1).alias("callee"),
        ),
    )
    nothing = lambda kind: F.lit(None).cast(kind)
    # A name behind a type has a blank before it, a call a point and a bracket.
    spaced = lambda c: c.contains(" ")
    # Only what stands in a type or outside of all blocks can be a member or a unit.
    opens_type = F.coalesce(F.col("opens").isin(TYPE_KINDS), F.lit(False))
    may_be_method = _has(ROUND) & ~closes & (in_scope | outside) & ~opens_type
    method = F.when(
        may_be_method & ~plain.contains("=") & plain.contains("(") & spaced(plain), F.regexp_extract(plain, java.METHOD_HEADER, 2)
    )
    is_unit = statement & outside & (plain.startswith("package ") | plain.startswith("import "))
    in_type = in_scope if wants("field", "constructor") else F.lit(False)
    field = F.when(~closes & ~opens_type & (in_type | is_unit) & ~left.contains("(") & spaced(left), _both(left, java.FIELD, 1, 2))
    constructor = F.when(
        is_block & in_scope & ~opens_type & _has(ROUND) & plain.contains("("), F.regexp_extract(plain, java.CONSTRUCTOR_HEADER, 1)
    )
    units = wants("package", "import")
    return (
        cut.withColumn("plain", F.when(_has(ODD), java.plain_header(text)).otherwise(F.trim(text)))
        .withColumn("left_side", F.when(_has(EQUALS), F.rtrim(F.substring_index("plain", "=", 1))).otherwise(plain))
        .withColumn("opens", F.when(is_block, _scope_kind(plain)))
        .select(
            *carried, "pos",
            # Spark keeps what lies above a column like this above it, so that no filter repeats the searches
            F.when(F.spark_partition_id() >= 0, F.col("mark")).alias("mark"),
            "level", "start", "mark_end", "end", "close_pos", "opens",
            F.when(is_block, plain).alias("header"),
            _type_name(F.col("opens"), plain).alias("opens_name"),
            (F.nullif(method, F.lit("")) if wants("method", "constructor") else nothing("string")).alias("method"),
            (field if units or wants("field", "constructor") else nothing("array<string>")).alias("fields"),
            (F.nullif(constructor, F.lit("")) if wants("constructor") else nothing("string")).alias("constructor"),
            (F.when(is_unit, _both(plain, java.UNIT, 1, 2)) if units else nothing("array<string>")).alias("units"),
            (F.when(_has(DOTTED) & _has(ROUND), calls) if kinds is None else nothing("array<struct<receiver string, callee string>>")).alias("calls"),
            "parent_id", "parent_start", "parent_kind", "parent_name",
        )
        .select(
            "*",
            F.get("fields", F.lit(1)).alias("field_type"),
            F.get("fields", F.lit(2)).alias("field"),
            F.get("units", F.lit(1)).alias("unit"),
            F.get("units", F.lit(2)).alias("unit_name"),
        )
        .withColumn("calls", F.when(F.size("calls") > 0, F.col("calls")))
        .drop("fields", "units")
    )


def declarations(files: DataFrame, kinds: Collection[str] | None = None, sources: bool = False) -> DataFrame:
    """Types, methods, constructors, anonymous bodies, other blocks, fields, package and
    import statements, and call sites.

    ``start`` and ``end`` are 0-based character offsets, ``end`` exclusive; ``decl_id`` is
    the position of the closing mark of the row's text within the file; rows in ``start``
    order are in preorder. Rows with a null ``kind`` are statements kept for their calls.

    ``kinds`` names the kinds that the caller keeps (types, members, package, import): the same rows
    as a filter on ``kind`` gives, with null ``calls``, but nothing is searched for the others. With
    ``sources``, rows come with the contents of the files of their path, null paths are left out.
    """
    is_block, outside = F.col("mark") == "{", F.col("parent_id").isNull()
    in_scope = F.col("parent_kind").isin(SCOPE_KINDS)
    reads_as = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"))
    read = F.col("method").isNotNull() | F.col("field").isNotNull() | F.col("calls").isNotNull()
    found = F.when(
        F.col("mark") != "}",
        F.when(F.col("opens").isin(TYPE_KINDS), F.struct(F.col("opens").alias("kind"), F.col("opens_name").alias("name")))
        .when(
            F.col("unit").isNotNull() & outside & (read | (F.col("level") == 0)),
            F.struct(F.col("unit").alias("kind"), F.col("unit_name").alias("name")),
        )
        .when((in_scope | outside) & F.col("method").isNotNull(), reads_as("method", "method"))
        .when(in_scope & F.col("field").isNotNull(), reads_as("field", "field"))
        .when(in_scope & F.col("constructor").isNotNull(), reads_as("constructor", "constructor"))
        .when(
            is_block,
            F.struct(F.coalesce("opens", F.lit("other")).alias("kind"), F.lit(None).cast("string").alias("name")),
        ),
    )
    if kinds is not None and not set(kinds) <= {*TYPE_KINDS, "package", "import", "method", "field"}:
        raise ValueError(f"only named types, units, methods and fields can be read alone: {sorted(kinds)}")
    wanted = F.col("found").isNotNull() | F.col("calls").isNotNull() if kinds is None else F.col("found.kind").isin(list(kinds))
    return (
        pieces(files, kinds, sources)
        .withColumn("found", found)
        .filter(wanted)
        .select(
            "path",
            F.col("pos").alias("decl_id"),
            "parent_id", "parent_kind", "parent_name", "parent_start",
            "found.kind",
            "found.name",
            F.col("level").alias("depth"),
            "start",
            "end",
            "header",
            F.when(is_block, F.col("mark_end")).alias("body_start"),
            "close_pos",
            F.when(F.col("found.kind") == "field", F.col("field_type")).alias("field_type"),
            "calls",
            *(["sources"] if sources else []),
        )
    )


def blocks(files: DataFrame) -> DataFrame:
    """Brace blocks only."""
    return (
        declarations(files)
        .filter(F.col("body_start").isNotNull())
        .select(
            "path", F.col("decl_id").alias("block_id"), "parent_id",
            F.when(F.col("kind") == "field", "other").otherwise(F.col("kind")).alias("kind"),
            "name", "depth", "start", "end", "header",
        )
    )
