"""Plain versions of operators: every place and every pair is looked at."""

import hashlib
import re
from collections import defaultdict

from codequarry.llm import decontamination


def dedup_lines(rows, min_sites, min_words):
    """(id, text without later occurrences of lines on many sites, lines, removed lines)."""
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            line = line.strip(" ")
            if re.match(r"\S+" + r"(\s+\S+)" * (min_words - 1), line):
                sites[line].add(s)
                first[line] = min(first.get(line, (i, pos)), (i, pos))
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        parts = t.split("\n")
        gone = {p for p, x in enumerate(parts) if len(sites.get(x.strip(" "), ())) >= min_sites and first[x.strip(" ")] != (i, p)}
        out.append((i, "\n".join(x for p, x in enumerate(parts) if p not in gone), len(parts), len(gone)))
    return sorted(out, key=str)


def shingles(text, size=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(links, nodes):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in links:
        a, b = sorted((find(x), find(y)))
        label[b] = a
    return {n: find(n) for n in nodes}


def similar(rows, percent=90, size=3):
    """id -> (number of shingles, smallest id of the component)."""
    sets = {i: shingles(t, size) for i, t in rows}
    links = [
        (x, y) for x in sets for y in sets
        if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])
    ]
    label = components(links, sets)
    return {i: (len(sets[i]), label[i]) for i in sets}


def words(text):
    return re.findall(decontamination.WORD, (text or "").translate(str.maketrans(decontamination.UPPER, decontamination.LOWER)))


def contamination(docs, items, size):
    """(id, words, hit words, items, digest, contaminated), sorted."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i:i + n])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)
