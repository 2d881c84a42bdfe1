import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lintmill.llm import toxicity
from lintmill.llm.common import written
from lintmill.llm.queries import op12_toxicity
from lintmill.llm.toxicity import ORDER, SCALE, WINDOW, count_grams, differences, fit_curve, grams, labelled, score, train, weigh


def plain_grams(text):
    """Each letter with the bytes before it in its word, each end of a word likewise; as tuples without padding."""
    out = []
    for word in re.findall(rb"[a-z0-9\x80-\xff]+(?:[^a-z0-9\x80-\xff]|$)", (text or "").encode().lower()):
        ended = not re.match(rb"[a-z0-9\x80-\xff]", word[-1:])
        word = b" " + (word[:-1] + b" " if ended else word)
        out += [word[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(word))]
    return out


def code(gram):
    return int.from_bytes(gram, "big")


def plain_weights(rows):
    counts = [Counter(), Counter()]
    for toxic, text in set(rows):
        counts[toxic].update(set(plain_grams(text)))
    everything = {code(g): (counts[1][g], counts[0][g]) for g in counts[0] | counts[1]}
    levels = [{c: sum(n) for c, n in everything.items()}]
    for order in range(ORDER - 1, 0, -1):
        levels.append(Counter(c & (1 << 8 * order) - 1 for c in levels[-1]))
    low = None
    for order, level in enumerate(reversed(levels), 1):
        total, kinds = Counter(), Counter()
        for c, n in level.items():
            total[c >> 8] += n
            kinds[c >> 8] += 1
        low = {c: (max(n - 0.75, 0) + 0.75 * kinds[c >> 8] * (1 / 256 if low is None else low[c & (1 << 8 * (order - 1)) - 1])) / total[c >> 8] for c, n in level.items()}
    out = {}
    for c in everything:
        p = []
        for k in (0, 1):
            same = [n[k] for x, n in everything.items() if x >> 8 == c >> 8]
            p.append((max(everything[c][k] - 1, 0) + (5 + sum(min(n, 1) for n in same)) * low[c]) / (sum(same) + 5))
        out[c] = math.log(p[0] / p[1]) * SCALE
    return out


def plain_best(text, weights):
    seen, values = set(), []
    for g in plain_grams(text):
        values.append(0 if g in seen else weights.get(code(g), 0))
        seen.add(g)
    return max((sum(values[i : i + WINDOW]) for i in range(max(1, len(values) - WINDOW + 1))), default=0)


TEXTS = ["", None, "The cat sat, on THE mat!", "a", " ", "...", "x9 éß 中文", "cat " * 30, "word\nword\n\nnext", "-a-", "idiot idiot clown and the rest " + "of it " * 20]


def test_grams():
    texts = [(t or "").encode() for t in TEXTS]
    codes, ends = grams(texts)
    begin = 0
    for text, end in zip(TEXTS, ends, strict=True):
        assert codes[begin:end].tolist() == [code(g) for g in plain_grams(text)], text
        begin = end


def test_weights_and_stretches(spark):
    rnd = random.Random(0)
    rows = [(rnd.randint(0, 1), " ".join(rnd.choice(["idiot", "idea", "clown", "the", "then", "été", "cloud"]) for _ in range(9))) for _ in range(40)]
    counts = written(count_grams(spark.createDataFrame(sorted(set(rows)), "toxic int, text string"), "toxic", "text"), "counts")
    weights = written(weigh(counts), "weights")
    got, expected = {r.code: r.weight for r in weights.collect()}, plain_weights(rows)
    assert got.keys() == expected.keys() and all(abs(got[c] - expected[c]) <= 1 for c in got)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("chunk", F.lit("x"))
    for limit in (None, 0):
        best = {r.id: r.best for r in differences(frame, weights, ["id", "chunk"], "text", limit).collect()}
        assert best == {i: plain_best(t, got) for i, t in enumerate(TEXTS)}


def test_learns_each_text_once(spark, docs):
    frame = docs([(1, "same"), (2, "same"), (3, "other"), (4, "none"), (5, ""), (6, "lost"), (7, "same")])
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 0), (4, None), (5, 1), (7, 0), (99, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    assert sorted((r.doc_id, r.toxic) for r in labelled(frame, labels).collect()) == [(1, 1), (3, 0), (7, 0)]


def test_curve():
    start, slope = fit_curve([(0, 900, 9), (50, 100, 90), (100, 50, 50)])
    p = [1 / (1 + math.exp(-start - slope * x / toxicity.STEPS)) for x in (0, 50, 100)]
    assert p[0] < 0.03 and p[1] > 0.7 and p[2] > 0.99
    assert fit_curve([])[1] >= 0 and fit_curve([(10, 5, 0), (-10, 5, 5)])[1] >= 0


def test_odd_rows(spark, docs):
    rnd = random.Random(2)
    words = ["cloud", "river", "stone", "field", "house", "water"]
    rows = []
    for i in range(300):
        text = [rnd.choice(words) + rnd.choice(words) for _ in range(40)]
        if i % 3 == 0:
            text[rnd.randrange(40)] = rnd.choice(["vexatron", "vexatrons", "vexatrony"])
            text[rnd.randrange(40)] = "vexatronic"
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = train(docs(rows), labels)
    odd = docs([(1, None), (2, ""), (3, "!!"), (4, "riverstone vexatroning " * 3), (4, "riverstone vexatroning " * 3), (None, "stonehouse"), (5, "field " * 300_000 + "vexatron vexatrons")])
    got = score(odd, model).collect()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.score <= 1
        by[r.doc_id].append(r.score)
    assert len(got) == 7 and by[1] == by[2] == by[3] and len(set(by[4])) == 1
    assert max(by[1] + by[None]) < 0.3 <= min(by[4] + by[5])


def test_nothing_to_learn_from(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    frame = docs([(1, "a text"), (2, None)])
    assert all(r.score < 0.3 for r in score(frame, train(frame, empty)).collect())
    assert score(docs([]), train(docs([]), empty)).count() == 0
    one_class = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.3 for r in score(frame, train(frame, one_class)).collect())


def test_query(spark, given):
    rows = op12_toxicity(spark, given).collect()
    assert len(rows) == spark.read.parquet(f"{given}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/check_s"), reason="the larger tables are not here")
def test_held_out_accuracy(spark):
    """On tables large enough to learn from."""
    sf = "/root/testdata/check_s"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op12_toxicity(spark, sf).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] >= 0.95 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
