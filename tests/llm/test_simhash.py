import numpy as np
import pytest
import xxhash

from codequarry.llm import simhash
from codequarry.llm.common import table
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"


def mark(text, size=3):
    """The fingerprint, bit by bit."""
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, distance=3):
    marks = [mark(t) for _, t in rows]
    links = [(x, y) for x in range(len(rows)) for y in range(x) if (marks[x] ^ marks[y]).bit_count() <= distance]
    label = plain.components(links, range(len(rows)))
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[label[x]] = min(least.get(label[x], i), i)
    return sorted(((i, f"{marks[x]:016x}", least.get(label[x])) for x, (i, _) in enumerate(rows)), key=str)


def found(docs, **options):
    return sorted(map(tuple, simhash.near_duplicates(docs, **options).collect()), key=str)


def test_documents_against_all_pairs(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows)
    assert found(docs) == want
    assert any(i != c for i, _, c in want)


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (3, "one"), (9, "One"), (9, "one two"), (None, "ONE"), (None, "alone here now"), (2, "x y z"), (5, "x Y z"),
            (11, "word " * 5000)]
    got = found(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id int, text string, fingerprint int, first int"))
    assert got == expected(rows)
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_texts_are_cut_into_words_in_pieces(monkeypatch):
    text = " ".join(f"Wort{i} Üb er" for i in range(300)) + "\x0b"
    whole = simhash.fingerprint(text)
    assert whole == mark(text)
    for chunk in (1, 7, 100):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert simhash.fingerprint(text) == whole


def same_components(spark, words, **options):
    frame = spark.createDataFrame([(int(w),) for w in words.view(np.int64)], "fingerprint bigint").repartition(3)
    got = [(r.x, r.y) for r in simhash.links(frame, 3, **options).collect()]
    ids = [int(w) for w in words.view(np.int64)]
    every = [(ids[x], ids[y]) for x in range(len(ids)) for y in np.flatnonzero(np.bitwise_count(words[:x] ^ words[x]) <= 3)]
    assert plain.components(got, ids) == plain.components(every, ids)
    return got, every


@pytest.mark.parametrize("parts", [1, 2, 4, 5])
def test_links_for_any_number_of_parts(spark, parts):
    rng = np.random.default_rng(parts)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, n, replace=False))) for b in base for n in (1, 2, 3, 4)]
    same_components(spark, np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)])), parts=parts)


def test_one_value_with_most_fingerprints_becomes_a_grid(spark):
    rng = np.random.default_rng(0)
    # three quarters agree on the lowest 40 bits; chains of near ones among them
    high = np.unique(rng.integers(0, 2**24, 240, dtype=np.uint64))
    words = np.unique(np.concatenate([(high << np.uint64(40)) | np.uint64(12345), rng.integers(0, 2**63, 80, dtype=np.uint64)]))
    got, _ = same_components(spark, words, parts=4, block=16)
    assert len(got) <= 12 * len(words)


def test_allocations_sum_up_and_avoid_common_values(spark):
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) & ~np.uint64(0xFFFF))  # sixteen bits are always zero
    frame = spark.createDataFrame([(int(w),) for w in words.view(np.int64)], "fingerprint bigint")
    index = simhash.build_index(frame, 3, 4)
    units = index.allocation(index.arranged(words))
    assert (units.sum(1) == 4).all()
    common = [i for i, v in enumerate(index.values(index.arranged(words))) if len(np.unique(v)) == 1]
    assert len(common) == 1 and (units[:, common[0]] == 0).all()
    assert (index.restored(index.arranged(words)) == words).all()
    values = index.values(index.arranged(words))[0]
    exact = [(np.bitwise_count(values ^ values[7]) <= e).sum() for e in range(4)]
    assert np.allclose(index.candidates(0, values[7:8])[:, 0], exact)
