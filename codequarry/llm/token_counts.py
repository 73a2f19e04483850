"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For every prefix of a text the exact number of tokens is known without encoding it anew. The
last token of a prefix's encoding is unique: it is the vocabulary entry that ends there and is
compatible with the last token of the shorter prefix. Two tokens are compatible when encoding
their joined bytes gives just these two. So counts follow in one pass from left to right,
linear in the text for a vocabulary of bounded token length.

Null texts count as empty and have no tokens. Texts of any length are read whole. The string of
a special token inside a text is one token, as the tokenizer's own default has it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import map_batches

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# White space before a space: there a chunk's count depends on its neighbour.
SPACE_RUN = re.compile(r"\s ")
SPACES = regex.compile(r"\s+")
# Remembered pieces per Python worker; beyond it the memory is emptied and filled anew.
REMEMBERED = 250_000


def byte_alphabet() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts per prefix of pre-tokens and texts.

    Tokens are numbered by age: single bytes first, then merges in order of rank.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        self.number = {bytes([b]): b for b in range(256)}
        self.parts = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for m in spec["model"]["merges"]:
            left, right = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            pair = (self.number[left], self.number[right])
            self.joined[pair] = self.number.setdefault(left + right, len(self.parts))
            if self.joined[pair] == len(self.parts):
                self.parts.append(pair)
        self.specials = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.special_pattern = (
            regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        )
        self.trie = self._trie()
        self.pairs: dict[int, bool] = {}  # left << 20 | right
        self.tables: dict[str, Sequence[int]] = {}
        self.chunks: dict[str, int] = {}

    def _trie(self) -> dict:
        """Byte -> (node below, token that ends here or -1)."""
        root: dict = {}
        for token, number in sorted(self.number.items()):
            node = root
            for b in token[:-1]:
                node = node.setdefault(b, ({}, -1))[0]
            node[token[-1]] = ({}, number)
        return root

    def _undisturbed(self, left: int, right: int) -> bool:
        """Whether merging never joins bytes across the border of the two tokens.

        Takes the merges inside both tokens back, youngest first. Before each, the tokens that
        then meet at the border must not have a merge older than the one just taken back.
        """
        border = len(self.parts)
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < border:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                border, left = left, self.parts[left][1]
            else:
                border, right = right + 1, self.parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) > 2 * REMEMBERED:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self._undisturbed(left, right)
        return known

    def byte_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for every i."""
        n, pairs, root = len(data), self.pairs, self.trie
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, node, here, end = last[start] << 20, root, counts[start] + 1, start
            for b in data[start:]:
                hit = node.get(b)
                if hit is None:
                    break
                node, token = hit
                end += 1
                if token >= 0 and last[end] < 0:
                    if start:
                        fits = pairs.get(before | token)
                        if fits is None:
                            fits = self.compatible(last[start], token)
                        if not fits:
                            continue
                    last[end], counts[end] = token, here
        return counts

    def piece(self, text: str) -> Sequence[int]:
        """Tokens of every prefix, by characters, of one pre-token."""
        known = self.tables.get(text)
        if known is None:
            data = text.encode("utf-8", "surrogatepass")
            known = self.byte_counts(data)
            if len(data) > len(text):
                known = [known[i] for i, b in enumerate(data) if b & 0xC0 != 0x80] + known[-1:]
            if len(text) <= 64:
                if len(self.tables) >= REMEMBERED:
                    self.tables.clear()
                known = self.tables[text] = bytes(known) if len(data) < 256 else known
        return known

    def segments(self, text: str) -> list[str]:
        """Ordinary parts at even places, special strings at odd ones."""
        if not self.special_pattern or not any(s in text for s in self.specials):
            return [text]
        return self.special_pattern.split(text)

    def _chunk(self, chunk: str) -> int:
        """Tokens of a space with the text up to the next space."""
        known = self.chunks.get(chunk)
        if known is None:
            known = sum(self.piece(p)[-1] for p in PRETOKEN.findall(" " + chunk))
            if len(chunk) <= 64:
                if len(self.chunks) >= REMEMBERED:
                    self.chunks.clear()
                self.chunks[chunk] = known
        return known

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entries of the tables of its pieces.

        A space between two characters that are no white space always starts a piece, so the
        text is taken apart there first.
        """
        total, parts = 0, self.segments(text)
        for part in parts[::2]:
            if not part or part[0].isspace() or part[-1].isspace() or SPACE_RUN.search(part):
                total += sum(self.piece(p)[-1] for p in PRETOKEN.findall(part))
                continue
            first, *rest = part.split(" ")
            total += sum(self.piece(p)[-1] for p in PRETOKEN.findall(first))
            try:
                total += sum(map(self.chunks.__getitem__, rest))
            except KeyError:
                total += sum(map(self._chunk, rest))
        return total + len(parts) // 2

    def _ordinary_table(self, text: str) -> np.ndarray:
        """Tokens of text[:i], special strings apart."""
        table, base = np.zeros(len(text) + 1, dtype=np.int32), 0
        for m in PRETOKEN.finditer(text):
            p = m.group()
            if p[0] == "'" and len(p) > 1:  # a cut contraction falls apart
                own = [sum(self.piece(x)[-1] for x in PRETOKEN.findall(p[:k])) for k in range(len(p) + 1)]
            else:
                own = self.piece(p)
            table[m.start():m.end() + 1] = base + np.array(list(own), dtype=np.int32)
            base += own[-1]
        for m in SPACES.finditer(text):  # white space at the end of a prefix is one pre-token
            table[m.start() + 1:m.end() + 1] = table[m.start()] + np.array(list(self.piece(m.group())[1:]), dtype=np.int32)
        return table

    def prefix_table(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text)."""
        table, parts, at, base = np.zeros(len(text) + 1, dtype=np.int32), self.segments(text), 0, 0
        for i in range(0, len(parts), 2):
            part, special = parts[i], parts[i + 1] if i + 1 < len(parts) else ""
            # until it is complete, a special string goes on the ordinary text before it
            own = self._ordinary_table(part + special[:-1])
            table[at:at + len(own)] = base + own
            at += len(part) + len(special)
            if special:
                base += int(own[len(part)]) + 1
                table[at] = base
        return table

    def longest_prefix(self, text: str, budget: int) -> int:
        """Length of the longest prefix that has at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_table(text) <= budget)[-1]) if budget >= 0 else 0


@cache
def counter(name: str) -> PrefixCounter:
    """One counter per Python worker; ``name`` is looked up where the task runs."""
    import public_tokenizers

    return PrefixCounter(name if os.path.exists(name) else public_tokenizers.path(name))


def token_counts(
    docs: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def count(b):
        texts = [t or "" for t in b["text"]]
        c = counter(tokenizer)
        n = [c.count(t) for t in texts]
        return {
            "doc_id": b["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
            "n_tokens": n, "over_limit": [x > limit for x in n],
        }

    return map_batches(rows, count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def prefix_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json"
) -> DataFrame:
    """doc_id, counts: the stored table, tokens of every prefix by characters."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def counts(b):
        c = counter(tokenizer)
        return {"doc_id": b["doc_id"], "counts": [c.prefix_table(t or "") for t in b["text"]]}

    return map_batches(rows, counts, "doc_id bigint, counts array<int>")


def cut_to_budget(counts: DataFrame, budget: int) -> DataFrame:
    """From the stored tables: doc_id, n_chars of the longest prefix within ``budget`` tokens."""
    place = F.array_max(F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: F.get("counts", i) <= budget))
    return counts.select("doc_id", place.cast("bigint").alias("n_chars"))
