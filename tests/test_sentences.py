import random

import pytest

from codequarry.operators import sentences as S


def corpus():
    """Texts with abbreviations, numbers, quotes; what stands behind an abbreviation is mostly a name."""
    draw = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("ra", "len", "tis", "no")]
    names = ["Smith", "Jones", "Miller", "Baker"]
    lines = []
    for _ in range(400):
        body = draw.choices(words, k=draw.randint(4, 9))
        if draw.random() < 0.4:
            body[draw.randint(1, len(body) - 1)] = f"{draw.choice(['Dr.', 'Mr.', 'Mrs.'])} {draw.choice(names)}"
        if draw.random() < 0.2:
            body[2] = "e.g. " + body[2]
        lines.append("The " + " ".join(body) + draw.choice([".", ".", ".", "?", "!"]))
    return lines


@pytest.fixture(scope="module")
def found(spark):
    lines = corpus()
    texts = [(i, " ".join(lines[20 * i:20 * i + 20])) for i in range(20)]
    texts += [(100, 'He met Dr. Smith today. The end.'), (101, '"Stop." The others left. They (all of them.) went on.'), (102, "In Fig. 3 it is so. The rest at 5. The end"),
              (103, None), (104, ""), (105, " \n "), (106, "One\n\ntwo three"), (107, "Wait... what?! No.")]
    rows = S.sentences(spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id int, text string, pos int, word string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.sent_id)):
        got.setdefault(r.doc_id, []).append(r.sentence)
    return lines, got


def test_texts_are_cut_where_their_sentences_end(found):
    lines, got = found
    for i in range(20):
        assert got[i] == lines[20 * i:20 * i + 20]


def test_abbreviations_quotes_and_odd_texts(found):
    _, got = found
    assert got[100] == ["He met Dr. Smith today.", "The end."]
    assert got[101] == ['"Stop."', "The others left.", "They (all of them.)", "went on."]
    assert got[102][0].startswith("In Fig.") and got[102][-1].endswith("The end")
    assert not {103, 104, 105} & set(got) and got[106] == ["One\n\ntwo three"] and got[107] == ["Wait...", "what?!", "No."]


def test_large_tables_of_words_are_shuffled(spark, monkeypatch, found):
    monkeypatch.setattr(S, "WORDS", 0)
    lines, _ = found
    docs = spark.createDataFrame([(i, " ".join(lines[20 * i:20 * i + 20])) for i in range(20)], "doc_id int, text string")
    got = sorted((r.doc_id, r.sent_id, r.sentence) for r in S.sentences(docs).collect())
    assert [s for _, _, s in got] == lines
    assert S.sentences(docs.limit(0)).count() == 0
