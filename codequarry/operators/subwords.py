"""Windows of a text that hold a fixed number of subword tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

# Texts whose tokens a task holds at once.
SLICE = 64


@cache
def _vocabulary(name: str):
    """One tokenizer per Python worker; a name that is no file is looked up where the task runs."""
    from tokenizers import Tokenizer

    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    found = Tokenizer.from_file(name)
    found.no_truncation()
    found.no_padding()
    return found


def _starts(n: int, size: int, overlap: int) -> range:
    """Where the windows of ``n`` tokens begin; the last one is the first that reaches the end."""
    return range(0, max(n - overlap, 1), size - overlap)


def subword_windows(texts: DataFrame, vocabulary: str, size: int = 512, overlap: int = 0) -> DataFrame:
    """``id, part, n_tokens, begin, stop, text, tokens`` of ``id, text``.

    The tokens of each whole text by the tokenizer file ``vocabulary``, without special tokens, cut
    into windows: all but a text's last hold exactly ``size`` tokens, and each repeats the last
    ``overlap`` of the one before. Leave room in ``size`` for special tokens that an encoder adds. ``tokens``
    are what it reads; ``begin`` and ``stop`` are characters of the text, whose window begins where the
    token before it stops, so windows cover the text, white space included. A character of several
    tokens that a border divides is in both windows. An empty text has one window without tokens, a null
    text none. Rows stay where they are; repeated ids are windows of each text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _vocabulary(vocabulary)
        for frame in frames:
            frame = frame[frame["text"].notna()]
            for first in range(0, len(frame), SLICE):
                part = frame.iloc[first:first + SLICE]
                rows = []
                for key, text, coded in zip(part["id"], part["text"], tokenizer.encode_batch(part["text"].tolist(), add_special_tokens=False)):
                    ids, stops = coded.ids, [0]
                    for _, stop in coded.offsets:
                        stops.append(max(stop, stops[-1]))
                    spans = list(coded.offsets)
                    for nth, at in enumerate(_starts(len(ids), size, overlap)):
                        end = min(at + size, len(ids))
                        begin = min(stops[at], spans[at][0]) if at < len(ids) else 0
                        begin, stop = (begin if at else 0), (stops[end] if end < len(ids) else len(text))
                        rows.append((key, nth, end - at, begin, stop, text[begin:stop], ids[at:end]))
                yield pd.DataFrame(rows, columns=["id", "part", "n_tokens", "begin", "stop", "text", "tokens"])

    key = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(
        cut, f"id {key}, part int, n_tokens int, begin int, stop int, text string, tokens array<int>"
    )
