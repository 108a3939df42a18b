"""Plain Python versions of the operators, for small fixtures."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def near_classes(rows, threshold=0.8, size=5):
    """{doc_id: class_id} of (doc_id, text) rows by comparing all pairs with a common shingle."""
    bags = []
    for _, text in rows:
        w = words(text)
        bags.append(Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter())
    df = Counter(s for bag in bags for s in bag)
    n = len(rows)
    weights = [{s: c * math.log((n + 1) / df[s]) for s, c in bag.items()} for bag in bags]
    total = [sum(w.values()) for w in weights]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def link(i, j):
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)

    by_text, by_shingle = {}, defaultdict(list)
    for i, (_, text) in enumerate(rows):
        link(by_text.setdefault(text or "", i), i)
        for s in weights[i]:
            by_shingle[s].append(i)
    common = defaultdict(float)
    for s, docs in by_shingle.items():
        for x, i in enumerate(docs):
            for j in docs[:x]:
                common[j, i] += min(weights[i][s], weights[j][s])
    for (i, j), least in common.items():
        if least >= (threshold - 1e-9) * (total[i] + total[j] - least):
            link(i, j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return {doc_id: smallest[root(i)] for i, (doc_id, _) in enumerate(rows)}


def near_lines(rows, threshold=0.8):
    """{(doc_id, line_no)} of the lines that resemble an earlier one, all pairs compared."""
    lines = []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            if words(line):
                lines.append(((doc_id, i), frozenset(words(line))))
    by_word, found, seen = defaultdict(list), set(), set()
    for x, (place, own) in enumerate(lines):
        if own in seen:
            found.add(place)
        else:
            common = Counter(y for w in own for y in by_word[w])
            if any(c >= (threshold - 1e-9) * (len(own) + len(lines[y][1]) - c) for y, c in common.items()):
                found.add(place)
            seen.add(own)
            for w in own:
                by_word[w].append(x)
    return found


def edited_text(text, following):
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def word_similarity(a, b):
    """Generalised Jaccard similarity of the word counts."""
    a, b = Counter(words(a)), Counter(words(b))
    return (a & b).total() / (a | b).total() if a or b else 1.0
