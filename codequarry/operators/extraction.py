"""Facts read out of source files: packages, imports, types, members, calls, snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions import java
from codequarry.functions.constants import COMMON_TYPES
from codequarry.functions.text import strip_space
from codequarry.operators.blocks import TYPE_KINDS, declarations
from codequarry.plans.placement import place

SNIPPETS = ["class", "method"]


def strip_comments(files: DataFrame) -> DataFrame:
    return files.select("path", java.strip_comments(F.col("content")).alias("content"))


def _base_name():
    return F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")


def extract_packages(files: DataFrame) -> DataFrame:
    """First package statement per file; the class name is the file's base name."""
    found = F.regexp_extract_all(
        java.blank_hidden(F.col("content")), F.lit(java.PACKAGE), F.lit(1)
    )
    # Exploding the first match drops files without one; a filter would read them twice.
    return files.select("path", F.explode(F.slice(found, 1, 1)).alias("package")).select(
        "path", "package", _base_name().alias("class_name")
    )


def declared_packages(decls: DataFrame) -> DataFrame:
    """The same as :func:`extract_packages`, from declarations already read."""
    first = decls.filter(F.col("kind") == "package").groupBy("path").agg(
        F.min(F.struct("start", F.col("name").alias("package"))).getField("package").alias("package")
    )
    return first.select("path", "package", _base_name().alias("class_name"))


def package_members(packages: DataFrame) -> DataFrame:
    """``package, class_name, files``: one row per member, so that no package, however
    large, has to fit into one list."""
    return packages.groupBy("package", "class_name").agg(F.count("*").alias("files"))


def filter_common_types(df: DataFrame, column: str, common: Sequence[str] = COMMON_TYPES) -> DataFrame:
    return df.filter(~F.col(column).isin(list(common)))


def extract_imports(files: DataFrame, common: Sequence[str] = COMMON_TYPES) -> DataFrame:
    """Plain imports; static and wildcard imports are not names of a type."""
    full = F.regexp_extract_all(
        java.blank_hidden(F.col("content")), F.lit(java.IMPORT), F.lit(1)
    )
    return _named_imports(files.select("path", F.explode(full).alias("full_name")), common)


def _named_imports(rows: DataFrame, common: Sequence[str]) -> DataFrame:
    simple = F.element_at(F.split("full_name", "[.]"), -1)
    return filter_common_types(
        rows.select("path", simple.alias("simple_name"), "full_name"), "simple_name", common
    )


def declared_imports(decls: DataFrame, common: Sequence[str] = COMMON_TYPES) -> DataFrame:
    """The same as :func:`extract_imports`, from declarations already read."""
    rows = decls.filter(F.col("kind") == "import").select("path", F.col("name").alias("full_name"))
    return _named_imports(rows, common)


def last_imports(imports: DataFrame) -> DataFrame:
    """Simple name -> full name; the import seen last, by path, wins."""
    return imports.groupBy("simple_name").agg(
        F.max(F.struct("path", "full_name")).getField("full_name").alias("full_name")
    )


def extract_types(decls: DataFrame, common: Sequence[str] = COMMON_TYPES) -> DataFrame:
    """Classes and interfaces; a class named like a common type is left out."""
    header = F.col("header")
    parent = F.regexp_extract(header, java.EXTENDS, 1)
    listed = strip_space(F.regexp_extract(header, java.IMPLEMENTS, 1))
    is_class = F.col("kind") == "class"
    return (
        decls.filter(F.col("kind").isin("class", "interface"))
        .filter(~(is_class & F.col("name").isin(list(common))))
        .select(
            "path", "name", "kind",
            F.when(is_class & (parent != ""), parent).alias("parent"),
            F.when(is_class & (listed != ""), listed).alias("implements"),
            "start", "end", "body_start",
        )
    )


def explode_implements(types: DataFrame) -> DataFrame:
    """One row per name of an ``implements`` list."""
    names = F.transform(F.split("implements", ","), strip_space)
    return (
        types.filter(F.col("implements").isNotNull())
        .select("path", "name", F.explode(names).alias("interface"))
        .filter(F.col("interface") != "")
    )


def slice_span(spans: DataFrame, files: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Add ``content``: the characters of a file between two offsets.

    Files are placed by path as the declarations are, so this join moves nothing twice.
    """
    source = place(files.select("path", F.col("content").alias("_source")), "path")
    text = F.substring(F.col("_source"), F.col(start) + 1, F.col(end) - F.col(start))
    return spans.hint("merge").join(source, "path").withColumn("content", text).drop("_source")


def extract_type_body(types: DataFrame, files: DataFrame) -> DataFrame:
    """Text between the braces of each type."""
    inner = types.select("path", "name", "start", "body_start", (F.col("end") - 1).alias("body_end"))
    return slice_span(inner, files, "body_start", "body_end").select(
        "path", "name", "start", F.col("content").alias("body")
    )


def _members(decls: DataFrame, kind: str, *extra: str) -> DataFrame:
    in_type = W.partitionBy("path", "parent_id").orderBy("start")
    return (
        decls.filter((F.col("kind") == kind) & F.col("parent_kind").isin(TYPE_KINDS))
        .select(
            "path", F.col("parent_id").alias("type_id"), F.col("parent_name").alias("type_name"),
            F.col("parent_kind").alias("type_kind"), F.col("parent_start").alias("start"),
            F.row_number().over(in_type).alias("ordinal"), *extra, "name",
        )
    )


def extract_methods(decls: DataFrame) -> DataFrame:
    """Methods declared directly in a named type, in source order."""
    return _members(decls, "method")


def extract_fields(decls: DataFrame) -> DataFrame:
    """Fields declared directly in a named type, in source order."""
    return _members(decls, "field", "field_type")


def members_by_type(decls: DataFrame) -> DataFrame:
    """Members listed per type in source order. A list holds one type of one file."""

    def listed(kind: str, shown):
        rows = F.collect_list(F.when(F.col("kind") == kind, F.struct("start", shown.alias("shown"))))
        return F.transform(F.array_sort(rows), lambda x: x["shown"])

    members = decls.filter(F.col("kind").isin("field", "method") & F.col("parent_kind").isin(TYPE_KINDS))
    return members.groupBy(
        "path", F.col("parent_id").alias("type_id"), F.col("parent_name").alias("type_name")
    ).agg(
        listed("field", F.concat_ws(" ", "field_type", "name")).alias("fields"),
        listed("method", F.col("name")).alias("methods"),
    )


def extract_calls(decls: DataFrame) -> DataFrame:
    """``receiver.method(`` pairs, each under its nearest enclosing method.

    Method braces count nesting up and down; a call asks for the latest method opened at
    its own nesting, which is the nearest one around it.
    """
    is_method = (
        (F.col("kind") == "method") & F.col("parent_kind").isin(TYPE_KINDS) & F.col("body_start").isNotNull()
    )
    mark = lambda pos, step: F.struct(pos.alias("pos"), F.lit(step).alias("step"))
    never = F.filter(F.array(mark(F.lit(0), 0)), lambda m: F.lit(False))
    end = F.coalesce("close_pos", F.lit(2**31 - 1))
    marks = decls.filter(is_method | F.col("calls").isNotNull()).select(
        "path",
        F.when(is_method, F.col("parent_name")).alias("type"),
        F.when(is_method, F.col("name")).alias("method"),
        "calls",
        F.inline(
            F.concat(
                F.when(F.col("calls").isNotNull(), F.array(mark(F.col("decl_id"), 0))).otherwise(never),
                F.when(is_method, F.array(mark(F.col("decl_id"), 1), mark(end, -1))).otherwise(never),
            )
        ),
    )
    # At one position the text comes before the brace, so calls go first.
    order = [F.col("pos"), F.col("step") != 0]
    run = W.partitionBy("path").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    same = W.partitionBy("path", "nesting").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    around = F.last(
        F.when(F.col("step") == 1, F.struct("type", "method")), ignorenulls=True
    ).over(same)
    return (
        marks.withColumn("nesting", F.sum("step").over(run))
        .withColumn("around", around)
        .filter((F.col("step") == 0) & (F.col("nesting") > 0))
        .select(
            "path", "pos",
            F.col("around.type").alias("caller_type"),
            F.col("around.method").alias("caller_method"),
            F.posexplode("calls").alias("nth", "call"),
        )
        .select("path", "caller_type", "caller_method", "pos", "nth", "call.receiver", "call.callee")
    )


def calls_by_method(calls: DataFrame) -> DataFrame:
    """Calls listed per method in source order. A list holds one method name of one file."""
    listed = F.array_sort(
        F.collect_list(F.struct("pos", "nth", F.concat_ws(".", "receiver", "callee").alias("call")))
    )
    return calls.groupBy("path", "caller_type", "caller_method").agg(
        F.transform(listed, lambda x: x["call"]).alias("calls")
    )


def snippets(files: DataFrame, decls: DataFrame | None = None, top_level_only: bool = False) -> DataFrame:
    """Class and method declarations with their text; ``start`` order is preorder.

    Without ``decls``, the files' rows carry their text along, and nothing is joined.
    """
    read = declarations(files, SNIPPETS, sources=True) if decls is None else decls
    wanted = F.col("kind").isin(SNIPPETS) & (F.col("name") != "")
    if top_level_only:
        wanted = wanted & (F.col("depth") == 0)
    spans = read.filter(wanted)
    if decls is None:
        text = F.substring(F.col("source.content"), F.col("start") + 1, F.col("end") - F.col("start"))
        sliced = spans.select("path", "kind", "name", "start", "end", "depth", F.explode("sources").alias("source")).withColumn("content", text)
    else:
        sliced = slice_span(spans.select("path", "kind", "name", "start", "end", "depth"), files)
    return sliced.select(
        F.concat_ws("#", "path", F.col("start").cast("string")).alias("snippet_id"),
        "path", "kind", "name", "start", "end", "depth", "content",
    )


def snippet_counts(snips: DataFrame) -> DataFrame:
    return snips.groupBy("kind").agg(
        F.count("*").alias("snippets"), F.countDistinct("path").alias("files")
    )


def flatten_snippets(nested: DataFrame, column: str = "snippets") -> DataFrame:
    """Lists of snippets per file to one row per snippet, order kept in ``nth``."""
    others = [c for c in nested.columns if c != column]
    return nested.select(*others, F.posexplode(column).alias("nth", "snippet"))


def group_snippets(snips: DataFrame) -> DataFrame:
    """Snippets listed per file in source order. A list holds one file."""
    listed = F.array_sort(F.collect_list(F.struct("start", "content")))
    return snips.groupBy("path").agg(F.transform(listed, lambda x: x["content"]).alias("snippets"))
