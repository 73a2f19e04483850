"""Language identification by bit-sliced Bloom filters over byte n-grams.

One table of slots holds a mask of languages each: bit l of a slot is set when an n-gram of
language l hashes there. An n-gram looks up a few slots; the AND of their masks are all languages
that contain it. Per language the hits of a text are counted and corrected for the share that its
filter answers by mistake; the highest corrected share decides.

Learning takes at most about ``sample_rows`` texts of each language, chosen by a hash of the id
(documented bound). A language's filter holds the n-grams that make up ``min_share`` of its own or
more, so at most 1 / min_share of them reach the driver. A mask is as many 64-bit words as the
languages need; up to 64 of them fit in one, which is then as narrow as it can be.

A null text or one without a letter is ``und`` with score 0. A text without any known n-gram gets
the most frequent language with score 0. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import fold, map_batches

GRAM = 4
NO_LETTERS = regex.compile(r"[^\p{L}]+")
LETTER = regex.compile(r"\p{L}")
# Text bytes handled at once in a task.
BLOCK = 1 << 20


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts as numbers, and the place of each text's first one.

    Words are lower-cased and parted by one space; a text has a space at either end.
    """
    clean = [(" " + NO_LETTERS.sub(" ", t.lower()).strip() + " ").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([max(0, len(c) - GRAM + 1) for c in clean])
    data = np.frombuffer(b"".join(clean) + b"\0" * GRAM, dtype=np.uint8).astype(np.uint32)
    n = len(data) - GRAM
    keys = sum((data[i:n + i] << np.uint32(8 * (GRAM - 1 - i)) for i in range(GRAM)), np.zeros(n, dtype=np.uint32))
    ends = np.cumsum([len(c) for c in clean])
    inside = np.ones(n, dtype=bool)
    for back in range(1, GRAM):  # windows that run over a text's end
        places = ends - back
        inside[places[places >= 0]] = False
    starts = np.concatenate([[0], ends[:-1]])
    for i in np.flatnonzero(sizes == 0):
        inside[starts[i]:ends[i]] = False
    return keys[inside], np.concatenate([[0], np.cumsum(sizes)])


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, gram, n over the rows given, summed in each task before the shuffle."""
    schema = "lang string, gram bigint, n bigint"

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            own = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own.setdefault(lang, []).append(text)
            for lang, texts in own.items():
                for a, b in blocks(texts):
                    keys, counts = np.unique(grams(texts[a:b])[0], return_counts=True)
                    old = held.get(lang)
                    if old is not None:
                        keys, at = np.unique(np.concatenate([old[0], keys]), return_inverse=True)
                        counts = np.bincount(at, np.concatenate([old[1], counts])).astype(np.int64)
                    held[lang] = keys, counts
        for lang, (keys, counts) in held.items():
            columns = [pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilters:
    """Masks per slot (one row per word of the mask), and per language the share of strangers that
    its filter lets pass."""

    languages: list[str]
    masks: np.ndarray
    mistakes: np.ndarray
    most_frequent: str

    def slots(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """One slot per hash function."""
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        for i in range(4):
            yield ((mixed + np.uint64(i) * step) & np.uint64(self.masks.shape[1] - 1)).astype(np.int64)

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """The mask of all languages that contain each n-gram, one row per word of the mask."""
        found = np.full((len(self.masks), len(keys)), -1, dtype=np.int64).astype(self.masks.dtype)
        for at in self.slots(keys):
            for word, mask in zip(found, self.masks):
                word &= mask[at]
        return found

    def place(self, language: int) -> tuple[int, np.generic]:
        """The word and the bit in it of a language."""
        word, bit = divmod(language, 8 * self.masks.dtype.itemsize)
        return word, self.masks.dtype.type(bit)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Per text and language the share of its n-grams that the language has, mistakes taken out."""
        keys, starts = grams(texts)
        found = self.languages_of(keys)
        one, total = self.masks.dtype.type(1), np.maximum(1, np.diff(starts))
        result = np.zeros((len(texts), len(self.languages)))
        for j in range(len(self.languages)):
            word, bit = self.place(j)
            hits = np.concatenate([[0], np.cumsum((found[word] >> bit) & one, dtype=np.int64)])
            share = (hits[starts[1:]] - hits[starts[:-1]]) / total
            result[:, j] = np.maximum(0, (share - self.mistakes[j]) / (1 - self.mistakes[j]))
        return result

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for a, b in blocks([t or "" for t in texts]):
            shares = self.shares([t or "" for t in texts[a:b]]) if self.languages else np.zeros((b - a, 1))
            best, total = shares.argmax(1), shares.sum(1)
            for t, j, s, whole in zip(texts[a:b], best, shares.max(1), total):
                if t is None or not LETTER.search(t):
                    langs.append("und")
                    scores.append(0.0)
                else:
                    langs.append(self.languages[j] if whole > 0 else self.most_frequent)
                    scores.append(float(s / whole) if whole > 0 else 0.0)
        return langs, scores


def build_filters(counts: dict[str, np.ndarray], rows: dict[str, int]) -> LanguageFilters:
    """Filters from each language's n-grams; ``rows``: texts per language."""
    languages = sorted(counts)
    kind = next((k for k, width in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= width), np.uint64)
    words = max(1, -(-len(languages) // (8 * np.dtype(kind).itemsize)))
    largest = max((len(c) for c in counts.values()), default=1)
    slots = 1 << max(10, int(np.ceil(np.log2(16 * max(1, largest)))))
    top = min(rows, key=lambda l: (-rows[l], l)) if rows else "und"
    filters = LanguageFilters(languages, np.zeros((words, slots), dtype=kind), np.zeros(len(languages)), top)
    for j, lang in enumerate(languages):
        word, bit = filters.place(j)
        for at in filters.slots(counts[lang]):
            filters.masks[word, at] |= kind(1) << bit
    for j in range(len(languages)):
        word, bit = filters.place(j)
        filters.mistakes[j] = float(((filters.masks[word] >> bit) & kind(1)).mean()) ** 4
    return filters


def learn(
    docs: DataFrame, sample_rows: int = 10_000, min_share: float = 2e-5, lang_col: str = "lang",
    text_col: str = "text", id_col: str = "doc_id",
) -> LanguageFilters:
    """Filters from the rows that have a language and are not held out."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, 4) != 2))
    rows = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    shares = [F.lit(v) for l, n in rows.items() for v in (l, min(1.0, sample_rows / n))]
    share = F.element_at(F.create_map(*shares), F.col(lang_col)) if shares else F.lit(0.0)
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    counted = gram_counts(known.filter(chance < share), lang_col, text_col)
    whole = counted.groupBy("lang").agg(F.sum("n").alias("whole"))
    kept = counted.join(F.broadcast(whole), "lang").filter(F.col("n") >= F.col("whole") * min_share)
    got = kept.select("lang", "gram").toArrow()
    langs, keys = np.array(got.column("lang").to_pylist(), dtype=object), got.column("gram").to_numpy().astype(np.uint32)
    return build_filters({l: keys[langs == l] for l in sorted(set(langs))}, rows)


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def predicted(b):
        langs, scores = filters.predict(b["text"])
        return {"doc_id": b["doc_id"], "lang_pred": langs, "score": scores}

    got = map_batches(rows, predicted, "doc_id bigint, lang_pred string, score double")
    return got.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
