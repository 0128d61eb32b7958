import re
from collections import Counter

import pytest

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts at the edges: none, blank, few words, repeats, odd characters, very long.
EDGES = [None, "", " \n\t ", "one", "a b c d", "a b c d e", "x " * 60, "Ab cD " * 30 + "　\xa0é 中文 😀", "word" * 50_000, "lorem ipsum " * 40_000, "# $ % & | < > * " * 30]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge texts twice over under other ids, columns with clashing names, a row without an id."""
    rows = [(i, t, "k", 1, "q") for i, t in enumerate(EDGES + EDGES)] + [(None, "no id here", "k", 2, "q"), (3, "one", "k", 1, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, id int, ids string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts: dict):
    """Smallest id that links at 75 per cent reach, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in having[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}
