"""Segmentations against all paths of small lattices, and round trips of whole texts."""

import random

import public_tokenizers
import pytest

from codequarry.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["th", "e", "in", " ", "  ", "é", "☃", "\n", "ab", "ing", "\t", "😀", "▁", "<s>", "THE"]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def all_paths(model, text):
    found = []

    def go(at, score, ids):
        if at == len(text):
            found.append((score, tuple(ids)))
        else:
            for end, s, piece in model.edges(text, at):
                go(end, score + s, ids + ([piece] if piece >= 0 else model._bytes(text[at])))

    go(0, 0.0, [])
    return sorted(found, reverse=True)


def test_n_best_against_all_paths(model):
    draw = random.Random(6)
    for _ in range(150):
        text = "".join(draw.choice(BITS[:11]) for _ in range(draw.randint(0, 4)))
        want = all_paths(model, model.marked(text))[:7]
        got = model.encode_n_best(text, 7)
        assert [round(s, 3) for s, _ in got] == [round(s, 3) for s, _ in want]
        assert len({p for _, p in got}) == len(got) and {p for _, p in got} <= {p for _, p in all_paths(model, model.marked(text))}
        assert model.encode(text)[1] == model.encode_n_best(text, 1)[0][1] == got[0][1]
        assert all(model.decode(p) == text for _, p in got)


def test_viterbi_is_an_exact_heuristic(model):
    text = model.marked("nationali")
    found = model.n_best(text, 40)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    assert [round(s, 3) for s, _ in found] == [round(s, 3) for s, _ in all_paths(model, text)[:40]]


def test_no_piece_stands_over_the_border_of_parts(model):
    draw, chars = random.Random(8), [c for p in model.ids for c in p] + ["\n", "²", "_", "٣"]
    for _ in range(2000):
        text = "".join(draw.choice(chars) for _ in range(12)) + draw.choice(list(model.ids))
        parts = model.cut.findall(text)
        assert "".join(parts) == text
        borders, at = set(), 0
        for p in parts[:-1]:
            at += len(p)
            borders.add(at)
        assert not any(start < x < end for start in range(len(text)) for end, _, _ in model.edges(text, start) for x in borders)


def test_queries_on_odd_rows(spark, monkeypatch):
    draw = random.Random(7)
    texts = [None, "", " ", "\n\n", "a" * 30_000, "long text of words " * 5000, "same", "same"]
    texts += ["".join(draw.choice(BITS) for _ in range(draw.randint(1, 40))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, pieces int, score string")
    digest = {r.doc_id: r for r in pieces.segmentation_digest(docs, 3).collect()}
    encoded = pieces.encode(docs, 3)
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    others = {r.doc_id: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        marked = "".join(x for x in (t or "") if x != pieces.MARK) == (t or "")
        assert not marked or (back[i] == (t or "") and digest[i].round_trip)
        assert digest[i].n_pieces == len(others[i].pieces) and digest[i].n_paths == 1 + len(others[i].others)
    assert (digest[0].n_pieces, digest[0].n_paths, digest[0].second_score) == (0, 1, None)
    assert pieces.segmentation_digest(docs.limit(0)).count() == 0


def test_first_path_is_the_library_encoding_of_whole_texts(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    draw = random.Random(9)
    texts = ["the history of nationalisation and for the others", "é☃ THE 😀\n\tin  the end", "a" * 5000, "", None]
    texts += ["".join(draw.choice(BITS[:12] + ["hello", "national", "schön", "12", "."]) for _ in range(draw.randint(1, 60))) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(100).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    digest = {r.doc_id: r for r in pieces.segmentation_digest(docs, 2).collect()}
    for r in pieces.encode(docs, 2).collect():
        assert r.pieces == library.encode(texts[r.doc_id] or ""), texts[r.doc_id]
        assert (digest[r.doc_id].n_pieces, digest[r.doc_id].n_paths) == (len(r.pieces), 1 + len(r.others))
        assert all(o.pieces != r.pieces and abs(o.score - digest[r.doc_id].second_score) < 1e-6 * abs(o.score) for o in r.others)


def test_paths_of_pairs_against_all_paths(model):
    """Score of every path: the sum, less what merging would cross."""
    draw = random.Random(11)

    def crossings(text):
        found = []

        def go(at, score, ids, last):
            if at == len(text):
                found.append((score, tuple(ids)))
                return
            for end, s, piece in model.edges(text, at):
                lost = 0.0
                if piece >= 0:
                    own = model.merge(model.names[piece])[1] == (piece,)
                    joined = last < 0 or model.merge(model.names[last] + model.names[piece])[1] == (last, piece)
                    lost = pieces.CROSSING * ((not own) + (not joined))
                go(end, score + max(s, model.floor) - lost, ids + ([piece] if piece >= 0 else model._bytes(text[at])), piece)

        go(0, 0.0, [], -1)
        return sorted(found, reverse=True)

    for _ in range(60):
        text = "".join(draw.choice(BITS[:11]) for _ in range(draw.randint(1, 4)))
        want, got = crossings(model.marked(text))[:5], model.encode_own_first(text, 5)
        assert [round(s, 3) for s, _ in got] == [round(s, 3) for s, _ in want]
        assert len({p for _, p in got}) == len(got) and got[0][1] == model.merge(model.marked(text))[1]


def test_shared_beginnings_change_nothing():
    draw, one = random.Random(12), pieces.Pieces(PATH)
    words = ["".join(draw.choice("abestrnioé一") for _ in range(draw.randint(1, 12))) for _ in range(400)]
    words += [w[:k] for w in words[:40] for k in range(1, len(w))] + ["x" * 70, "x" * 64, "x" * 71 + "y"]
    one.remember([" ".join(words)], 3, True)
    for w in words:
        fresh = pieces.Pieces.__new__(pieces.Pieces)
        fresh.__dict__.update(one.__dict__, trail=pieces.start_of_trail(), parts={})
        part = pieces.MARK + w
        assert one.n_best_merged(part, 3) == fresh.n_best_merged(part, 3) and fresh.n_best_merged(part, 1)[0][1] == one.merge(part)[1]
