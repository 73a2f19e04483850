"""Token counts against the tokenizer library itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codequarry.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "th", "ing", " ", "  ", "\n", "'", "'s", "'ll", "'re", "!", "é", "中", "😀", "1", "23", "<|endoftext|>",
    "<|end", "\x1c", "\x85", "​", " ", "　", "\t", "ǅ", "²", "İ", "'T", "onest", "THE",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lib_count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_count_of_the_library(library):
    draw, counter = random.Random(5), tc.PrefixCounter(PATH)
    for _ in range(400):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12)))
        want = [lib_count(library, text[:i]) for i in range(len(text) + 1)]
        assert counter.prefix_table(text).tolist() == want
        assert counter.count(text) == want[-1]
        assert counter.longest_prefix(text, 3) == max(i for i, n in enumerate(want) if n <= 3)


def test_very_long_word_and_forgotten_pieces(library, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    counter, text = tc.PrefixCounter(PATH), "abcdefghij" * 3000 + " the end of the text is near"
    assert counter.count(text) == lib_count(library, text)


def test_query_rows(spark, library):
    texts = [None, "", "  ", "The end<|endoftext|> of it.", "word " * 2000, "The end<|endoftext|> of it."]
    docs = spark.createDataFrame(
        [(i, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string, n_bytes int"
    )
    rows = {r.doc_id: r for r in tc.token_counts(docs).collect()}
    for i, t in enumerate(texts):
        n = lib_count(library, t or "")
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert tc.token_counts(docs.limit(0)).count() == 0


def test_budget_from_stored_tables(spark, library):
    docs = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_chars for r in tc.cut_to_budget(tc.prefix_counts(docs), 2).collect()}
    assert lib_count(library, "one two three four"[: got[1]]) <= 2 and got[2] == 0
    assert got[1] == len("one two")
