"""Text expressions: every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"
SENTENCE_GAP = r"(?<=[.!?])\s+"
SPACES = " \t\n\x0b\f\r"


def strip_space(text: Column) -> Column:
    """Trim all whitespace, newlines included (SQL ``trim`` removes blanks only)."""
    return F.trim(text, F.lit(SPACES))


def clean_label(text: Column) -> Column:
    """Collapse whitespace, then escape ``&``, ``<`` and ``>`` for diagram labels."""
    flat = strip_space(F.regexp_replace(text, r"\s+", " "))
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        flat = F.replace(flat, F.lit(raw), F.lit(escaped))
    return flat


def sentence_array(text: Column) -> Column:
    """Sentences of a text in order; whitespace-only pieces are left out."""
    pieces = F.transform(F.split(text, SENTENCE_GAP), strip_space)
    return F.filter(pieces, lambda s: s != "")


def word_array(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased words of two or more characters, repeats kept, stop words dropped."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def count_words(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def token_windows(text: Column, size: int = 512) -> Column:
    """Consecutive runs of ``size`` whitespace-separated words covering the whole text.

    Run 0 is what an encoder capped at ``size`` tokens would read; the later runs hold
    the rest, so that a long text can be encoded whole and mean-pooled.
    """
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    last = F.greatest(F.floor((F.size(words) - 1) / size), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice(words, i * size + 1, size), " "),
    )
