"""Java source expressions: comment removal and the patterns used on headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.constants import CONTROL_WORDS, MODIFIERS

# One alternative per lexical unit that can hide a brace: text block, block comment,
# line comment, string, char literal. Possessive and unrolled, so a long literal does not
# recurse in the regex engine. Java and Python read it alike.
HIDDEN = (
    r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""'
    r"|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
    r"|//[^\n]*+"
    r'|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
    r"|'(?:\\[^\n]{1,6}?|[^'\\\n])'"
)
# Hidden units; then plain runs; then any single leftover.
LEXEMES = HIDDEN + r"""|[^"/']++""" + r"|[\s\S]"

# Words that no type and no variable can have as its name, so nothing after one is declared by it.
RESERVED = MODIFIERS + CONTROL_WORDS + [
    "package", "import", "class", "interface", "enum", "extends", "implements", "throws", "instanceof", "case", "assert",
    "yield", "break", "continue", "do", "try", "finally", "super", "this", "null", "true", "false",
]

# Names as the language has them: any script, digits, _ and $.
NAME = r"\p{javaJavaIdentifierStart}\p{javaJavaIdentifierPart}*+"
DOTTED = rf"{NAME}(?:\.{NAME})*"
_NO_PART = r"(?!\p{javaJavaIdentifierPart})"
_MODS = "(?:" + "|".join(MODIFIERS) + ")" + _NO_PART
_NOT_NAME = "(?!(?:" + "|".join(MODIFIERS + CONTROL_WORDS) + ")" + _NO_PART + ")"
# Brackets are matched by patterns to this depth, and by counting beyond it.
DEPTH = 40


def nested(left: str, right: str, depth: int = DEPTH) -> str:
    """Pattern of a balanced bracket with whatever is inside."""
    plain = rf"[^\{left}\{right}]++"
    inside = rf"(?:{plain})?+"
    for _ in range(depth - 1):
        inside = rf"(?:{plain}|\{left}{inside}\{right})*+"
    return rf"\{left}{inside}\{right}"


PACKAGE = rf"(?:^|[;\s])package\s+({DOTTED})\s*;"
IMPORT = rf"(?:^|[;\s])import\s+({DOTTED})\s*;"
UNIT = rf"^(package|import) ({DOTTED})$"
# A token with the blanks before it; a dotted name is one token, blanks around its dots included.
TOKEN = rf"\s*+(?:{NAME}(?:\s*+\.\s*+{NAME})*+|[0-9][\p{{javaJavaIdentifierPart}}.]*+|->|::|\.\.\.|&&|\|\||[\s\S])"
CALL = rf"({NAME})\.({NAME})\("
ANNOTATION = rf"@(?!interface{_NO_PART}){DOTTED}"
# An annotation with its arguments; then other text.
ANNOTATED = rf"{ANNOTATION}(?:\s*+{nested('(', ')')})?+|[^@]++|@"
TYPE_HEADER = rf"(?<![@.\p{{javaJavaIdentifierPart}}])(class|interface|enum|record)\s+({NAME})"
ANONYMOUS_HEADER = rf"(?s)(?<!\p{{javaJavaIdentifierPart}})new\s+{DOTTED}\s*\(.*\)$"
EXTENDS = rf"(?<!\p{{javaJavaIdentifierPart}})extends\s+({DOTTED})"
IMPLEMENTS = rf"(?<!\p{{javaJavaIdentifierPart}})implements\s+({DOTTED}(?:\s*,\s*{DOTTED})*)"
_THROWS = rf"throws\s+{DOTTED}(?:\s*,\s*{DOTTED})*\s*"
METHOD_HEADER = (
    rf"(?:^|\s){_NOT_NAME}({DOTTED})(?:\s*\[\s*\])*"
    rf"\s+{_NOT_NAME}({NAME})\s*\([^()]*\)\s*(?:\[\s*\]\s*)*(?:{_THROWS}|default{_NO_PART}[\s\S]*)?$"
)
CONSTRUCTOR_HEADER = rf"^(?:{_MODS}\s+)*({NAME})\s*\([^()]*\)\s*(?:{_THROWS})?$"
FIELD = rf"^(?:{_MODS}\s+)*{_NOT_NAME}({DOTTED})(?:\s*\[\s*\])*\s+{_NOT_NAME}({NAME})\s*(?:\[\s*\]\s*)*$"
GENERIC = nested("<", ">")


def lexemes(code: Column) -> Column:
    """Split code so that the pieces, joined, give the code back."""
    return F.regexp_extract_all(code, F.lit(LEXEMES), F.lit(0))


def _is_comment(t: Column) -> Column:
    return t.startswith("//") | t.startswith("/*")


def _is_literal(t: Column) -> Column:
    return t.startswith('"') | t.startswith("'")


def strip_comments(code: Column) -> Column:
    """Remove block and line comments; literals that look like comments stay."""
    return F.array_join(F.filter(lexemes(code), lambda t: ~_is_comment(t)), "")


def _blank(t: Column) -> Column:
    return F.repeat(F.lit(" "), F.length(t))


def blank_literals(code: Column) -> Column:
    """Comments and literals become blanks of the same length, so offsets hold."""
    return F.array_join(
        F.transform(lexemes(code), lambda t: F.when(_is_comment(t) | _is_literal(t), _blank(t)).otherwise(t)), ""
    )


def blank_hidden(code: Column) -> Column:
    """Comments, literals and annotation arguments become blanks of the same length, so offsets hold."""
    shown = blank_literals(code)

    def without_arguments(t: Column) -> Column:
        name = F.substring_index(t, "(", 1)
        return F.when(t.startswith("@") & t.contains("("), F.concat(name, F.repeat(F.lit(" "), F.length(t) - F.length(name)))).otherwise(t)

    parts = F.regexp_extract_all(shown, F.lit(ANNOTATED), F.lit(0))
    blanked = F.array_join(F.transform(parts, without_arguments), "")
    # nothing but an annotation's own arguments can follow it in round brackets
    deep = F.when(blanked.rlike(rf"{ANNOTATION}\s*+\("), blank_arguments(blanked)).otherwise(blanked)
    return F.when(code.contains("@"), deep).otherwise(shown)


def blank_arguments(code: Column) -> Column:
    """Annotation arguments of any depth become blanks: brackets are counted from the annotation on."""
    parts = F.regexp_extract_all(code, F.lit(rf"{ANNOTATION}\s*+\(|[()]|[^()@]++|@"), F.lit(0))
    empty = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        depth, opens = state["depth"], part.endswith("(") & (part.startswith("@") | (state["depth"] > 0))
        name = F.substring_index(part, "(", 1)
        shown = F.when(depth > 0, _blank(part)).when(opens, F.rpad(name, F.length(part), " ")).otherwise(part)
        after = F.when(opens, depth + 1).when((depth > 0) & (part == ")"), depth - 1).otherwise(depth)
        return F.struct(after.alias("depth"), F.concat(state["out"], F.array(shown)).alias("out"))

    return F.array_join(F.aggregate(parts, empty, step)["out"], "")


def without_brackets(text: Column, left: str, right: str) -> Column:
    """Text without its balanced brackets and what is inside, at any depth; as it is if one stays open."""
    parts = F.regexp_extract_all(text, F.lit(rf"[^{left}{right}]++|[{left}{right}]"), F.lit(0))

    def step(state: Column, part: Column) -> Column:
        depth = state["depth"]
        after = F.when(part == left, depth + 1).when((part == right) & (depth > 0), depth - 1).otherwise(depth)
        shown = F.when((depth > 0) & (after == 0), " ").when((depth > 0) | (after > 0), "").otherwise(part)
        return F.struct(after.alias("depth"), F.concat(state["out"], shown).alias("out"))

    done = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step)
    return F.when(done["depth"] == 0, done["out"]).otherwise(text)


def plain_header(header: Column) -> Column:
    """Header without annotations and type arguments; most have none, nor blanks to join."""
    out = F.when(header.contains("@"), F.regexp_replace(header, ANNOTATION, " ")).otherwise(header)
    out = F.when(out.contains("<"), F.regexp_replace(out, GENERIC, " ")).otherwise(out)
    out = F.when(out.contains("<") & out.contains(">"), without_brackets(out, "<", ">")).otherwise(out)
    odd = header.contains("@")
    for part in ("<", "  ", *"\t\n\u000b\f\r"):
        odd = odd | header.contains(part)
    return F.trim(F.when(odd, F.regexp_replace(out, r"\s+", " ")).otherwise(header))
