"""Personal data against Python's own pattern matching and a count of co-occurrences."""

import hashlib
import random
import re
from math import log

from codequarry.llm import pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            keep = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                "card": 12 <= len(d) <= 19 and luhn(d or "0"), "phone": 9 <= len(d) <= 15,
            }[kind]
            if keep:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[n]}:{a}:{b}" for a, n, b in spans)


def _check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, kind int")
    rows = {r.doc_id: r for r in pii.span_digest(docs, pii.find_spans(docs)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert rows[i].spans == listed(want), t
        assert rows[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(n == j for _, n, _ in want) for j in range(4)]


def test_random_texts(spark):
    draw = random.Random(2)
    parts = ["a@b.c", "x.y", "@", ".", "d@e.f_g@h.i", "1.2.3.4", "255.256.1.1", "007.1.01.0255", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+49 (30) 123-4567", "+1", " ", "-", "\n", "5", "12", "é", "😀", "%", "+", "(", "0", "79927398713", "4000056655665556", "..", "1.2.3.4.5.6.7.8"]
    _check(spark, ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(1500)])


def test_odd_texts(spark):
    _check(spark, [None, "", "4" * 50_000, "a" * 200_000 + "@b", ("a" * 50_000 + " 1.") * 2, "m@x.de " * 3000, "1 " * 40_000, "+1" + "(" * 50_000, "x@" + "a." * 20_000 + "b"])
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.span_digest(empty, pii.find_spans(empty)).count() == 0


def _corpus():
    rows = [(i, f"Contact {n} Zyxwick by boss@corp.com {n}\nThe weather in spring is mild {n}") for i, n in enumerate("one two three four five".split())]
    rows += [(10 + i, f"The weather by contact in spring number {i} is mild") for i in range(60)]
    rows += [(80, "Only Zyxwick here"), (81, None), (82, "")]
    rows += [(90 + i, "Copied Qwertus of solo@corp.com stands in copies") for i in range(20)]
    return rows


def test_terms_that_reveal_an_entity(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    terms = {r.term: r.disclosure for r in pii.revealing_terms(docs, pii.base_matches(docs), 0.8, 3).collect()}
    n = len(rows)
    assert set(terms) == {"zyxwick"}  # common words tell little, copies of one line are no evidence
    assert abs(terms["zyxwick"] - log(5 * n / (5 * 6)) / log(n / 5)) < 1e-9
    found = {r.doc_id: r for r in pii.span_digest(docs, pii.find_spans(docs)).collect()}
    assert found[80].spans == "term:5:12" and found[80].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[0].spans == "term:12:19,email:23:36" and found[0].n_email == 1


def test_sanitised_texts(spark):
    docs = spark.createDataFrame(_corpus() + [(200, "+4111111111111111 ü a@b.cd!"), (201, "+4111111111111111 ü a@b.cd!")], "doc_id bigint, text string")
    texts = {r.doc_id: r.text for r in pii.sanitise(docs, pii.find_spans(docs)).collect()}
    assert len(texts) == docs.count()
    assert texts[0].startswith("Contact one <term> by <email> one\n") and texts[80] == "Only <term> here"
    assert texts[200] == texts[201] == "+<card> ü <email>!" and texts[82] == "" and texts[10] == _corpus()[5][1]


def test_repeated_rows_and_shuffle_join(spark, monkeypatch):
    rows = _corpus() + _corpus()[:3]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, pii.span_digest(docs, pii.find_spans(docs)).collect()))
    assert len(want) == len(rows)
    monkeypatch.setattr(pii, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, pii.span_digest(docs, pii.find_spans(docs)).collect())) == want


def test_entities_seen_twice_are_judged_over_whole_documents(spark):
    rows = [(i, f"Plain weather in spring number {i}") for i in range(400)]
    rows += [(500, "Write to pair@corp.com today\nabout Zyxwick"), (501, "Zyxwick\nhas pair@corp.com as address"), (502, "Qwertus has once@corp.com")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    terms = {r.term: r.disclosure for r in pii.revealing_terms(docs, pii.base_matches(docs)).collect()}
    assert terms == {"zyxwick": 1.0}
    found = {r.doc_id: r.spans for r in pii.span_digest(docs, pii.find_spans(docs)).collect()}
    assert found[500] == "email:9:22,term:35:42" and found[501] == "term:0:7,email:12:25"


def test_rows_without_an_id_and_ids_with_several_texts(spark):
    rows = [(None, "mail a@b.cd"), (None, "at 1.2.3.4"), (None, "mail a@b.cd"), (1, "x@y.z"), (1, "+4912345678901"), (1, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.spans, r.n_email, r.n_ip, r.n_phone) for r in pii.span_digest(docs, pii.find_spans(docs)).collect()), key=str)
    want = [(i, listed(brute(t)), *[sum(n == k for _, n, _ in brute(t)) for k in (0, 1, 3)]) for i, t in rows]
    assert got == sorted(want, key=str)
