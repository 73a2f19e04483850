import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from codequarry.llm import conversations as c
from codequarry.llm.common import table

FIXED = {0: "user", 1: "user", 3: "user", 2: "assistant"}
NEXT = {0: 2, 1: 2, 3: 2, 2: 3}


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            out[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def mend(rows):
    """Everything of one conversation, by trying all edits row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", [])}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def insert(ways):
        for _ in range(3):
            for s, (cost, audit, lines) in list(ways.items()):
                put(ways, NEXT[s], (cost + 3, audit + "I", lines + [f"{FIXED[s]}:"]))
        return ways

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for s, (cost, audit, lines) in insert(best).items():
            put(after, s, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                put(after, NEXT[s], (cost + 3 + more, audit + "R", lines + [f"{FIXED[s]}:{text}"]))
                if role[:1] == "s" and s == 0:
                    put(after, 1, (cost + more, audit + "K", lines + [f"{role}:{text}"]))
                if role[:1] == FIXED[s][0]:
                    put(after, NEXT[s], (cost + more, audit + "K", lines + [f"{role}:{text}"]))
        best = after
    best = insert(best)
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda w: w[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    return sorted(((conv, *mend(got)) for conv, got in damage(rows).items()), key=str)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 7, 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, n int, place int")
    return sorted(map(tuple, c.repair(c.damaged(frame), frame, **options).collect()), key=str)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_conversations_of_the_tables(spark, folder):
    talks = table(spark, f"/root/testdata/{folder}", "conversations")
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    got = c.repair(c.damaged(talks), talks)
    assert got.columns == c.RESULT
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_random_conversations_in_short_pieces(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(25)]:
        for _ in range(rng.choice([1, 2, 3, 8, 40])):
            turn = rng.choice([None, *range(-3, 30)])
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", "why", " ", "", None, "Fine?\n", "a. b", "Ünd."])))
    rows += rows[:40] + rows[:10]  # repeated rows
    assert found(spark, rows, chunk=3, fan=2) == expected(rows)


def test_one_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2 if t % 11 else 0], f"Turn {t}." if t % 7 else "cut") for t in range(600)]
    rows += [(2, t, "user", "Same.") for t in range(50)] + [(3, None, "user", "Same.")] * 60
    assert found(spark, rows, chunk=16, fan=3) == expected(rows)


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(spark, []) == []


def test_grammar_gives_the_sequences_back(spark):
    texts = ["uauaua", "suauaua", "uaUaua-", "uuuuuuuuu", "", "a"] * 2 + ["uauaua"] * 5
    grammar = c.learn(spark.createDataFrame([(t,) for t in texts], "symbols string"), most=3)
    assert grammar.size() > 3
    made = {number: pair for rules in grammar.rounds for pair, number in rules.items()}

    def expand(x):
        return expand(made[x][0]) + expand(made[x][1]) if x in made else x

    for t in texts:
        short = grammar.compressed(list(t))
        assert "".join(map(expand, short)) == t and len(short) <= max(1, len(t))
    matrices = grammar.matrices()
    for number in made:
        plain = c.UNIT
        for letter in expand(number):
            plain = c.product(plain, c.SYMBOLS[letter])
        assert c._stored(plain) == c._stored(matrices[number])
    assert c.learn(spark.createDataFrame([], "symbols string")).rounds == []


def test_pairs_of_a_run_do_not_overlap():
    assert c.pairs(list("uuu")) == {("u", "u"): 1} and c.pairs(list("uuuu")) == {("u", "u"): 2}
    assert c.pairs(list("uuua")) == {("u", "u"): 1, ("u", "a"): 1}
    assert c.chosen([(("u", "a"), 5), (("a", "u"), 4), (("s", "u"), 3), (("s", "a"), 3)], 9) == [("u", "a"), ("s", "a")]
