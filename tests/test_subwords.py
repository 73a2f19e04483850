import pytest

from codequarry.operators import embedding, subwords

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
NAME = "byte_bpe_50k.json"
TEXTS = {
    1: "The quick brown fox  jumps over\n\nthe lazy dog. " * 40, 2: "", 3: None, 4: "word", 5: "漢字 Élan 🙂🙂 naïve\t" * 30, 6: "   ",
    7: "x" * 3000, 8: "class A { int a = 1; }\r\n" * 25 + "  ",
}


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(NAME))


@pytest.mark.parametrize("size,overlap", [(16, 0), (16, 5), (1, 0), (512, 64)])
def test_windows_against_the_library(spark, library, size, overlap):
    texts = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    found = {}
    for r in subwords.subword_windows(texts, NAME, size, overlap).orderBy("id", "part").collect():
        found.setdefault(r.id, []).append(r)
    assert set(found) == {k for k, t in TEXTS.items() if t is not None}
    for key, windows in found.items():
        text, want = TEXTS[key], library.encode(TEXTS[key], add_special_tokens=False).ids
        ids = windows[0].tokens + [t for w in windows[1:] for t in w.tokens[overlap:]]
        assert ids == want and library.decode(ids) == text
        assert [w.part for w in windows] == list(range(len(windows)))
        assert all(w.n_tokens == len(w.tokens) == size for w in windows[:-1]) and windows[-1].n_tokens <= size
        assert len(windows) == 1 or windows[-1].n_tokens > overlap
        assert windows[0].begin == 0 and windows[-1].stop == len(text)
        assert all(b.begin <= a.stop for a, b in zip(windows, windows[1:]))
        for w in windows:
            assert w.text == text[w.begin:w.stop]
            assert library.decode(w.tokens).strip("�") in w.text


def test_vectors_of_windows(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma " * 50), (2, "")], "id long, text string")
    windows = subwords.subword_windows(texts, NAME, 20)
    rows = {r.id: r.embedding for r in embedding.embed_windows(windows, 32).collect()}
    each = [r.embedding for r in embedding.embed(windows.filter("id = 1").select("part", "text").toDF("id", "text"), 32).collect()]
    assert len(each) > 5 and not any(rows[2])
    assert rows[1] == pytest.approx([sum(column) / len(each) for column in zip(*each)])


def test_bounds(spark):
    texts = spark.createDataFrame([], "id long, text string")
    assert subwords.subword_windows(texts, NAME).count() == 0
    with pytest.raises(ValueError):
        subwords.subword_windows(texts, NAME, 8, 8)
