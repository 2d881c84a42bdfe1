import random
from collections import Counter

import pytest

from lintmill.llm import ngram_join
from lintmill.llm.graph import components
from lintmill.llm.ngram_join import join_components, keep_one
from lintmill.llm.queries import op7_ngram_jaccard_join


def plain(rows):
    """doc_id, set size and component of every row, from all pairs that share an n-gram."""
    by = {}
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        grams = frozenset(tuple(w[j : j + 4]) for j in range(max(len(w) - 3, 1))) if w else frozenset()
        sets.append((i, grams))
        by.setdefault(grams, []).append(i)
    parent = {g: g for g in by if g}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posting = {}
    for g in parent:
        for gram in g:
            posting.setdefault(gram, []).append(g)
    for g in parent:
        for other, n in Counter(o for gram in g for o in posting[gram]).items():
            if 100 * n >= 85 * (len(g) + len(other) - n) and find(g) != find(other):
                parent[find(g)] = find(other)
    least = {}
    for g in parent:
        least[find(g)] = min(least.get(find(g), 1 << 60), *by[g])
    return sorted((i, len(g), least[find(g)] if g else i) for i, g in sets)


def families(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    edit = lambda w, p: [rng.choice(words) if rng.random() < p else x for x in w]
    texts = ["", "a b", "A B", "a", "a b c d", "a b c d", None, "x " * 30_000]
    shared = [rng.choice(words) for _ in range(50)]
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([5, 8, 20, 60, 150, 400]))]
        texts += [" ".join(edit(base, rng.choice([0, 0.005, 0.01, 0.02, 0.04]))) for _ in range(20)]
    for _ in range(3):  # chains, whose ends are far apart
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(20):
            base = edit(base, 0.012)
            texts.append(" ".join(base))
    texts += [" ".join(shared + [rng.choice(words) for _ in range(rng.randint(10, 80))]) for _ in range(40)]  # a passage in many
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize(("block", "rounds"), [(256, 1), (3, 0), (5, 3)])
def test_against_all_pairs(spark, docs, monkeypatch, block, rounds):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rows = families(block)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join_components(docs(rows)).collect())
    assert got == plain(rows)


def test_query_against_all_pairs(spark, given):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{given}/documents.parquet").collect()]
    assert sorted(map(tuple, op7_ngram_jaccard_join(spark, given).collect())) == plain(rows)


def test_odd_rows(docs):
    frame = docs([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "q"), (2, "z"), (None, None), (None, "solo x y z w")])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join_components(frame).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 1, "2"), ("2", 1, "2"), ("None", 0, "None"), ("None", 2, "1"), ("None", 2, "None")]
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "a b c d e", "q", "solo x y z w", "z"]
    assert join_components(docs([])).count() == keep_one(docs([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)] + [(300, 400 + i) for i in range(50)]
    roots = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {300: 300} | {400 + i: 300 for i in range(50)}
