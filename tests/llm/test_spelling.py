import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintmill.llm import spelling
from lintmill.llm.common import written
from lintmill.llm.spelling import group_variants, near_words, runs

LETTERS = [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *map(chr, range(0xC0, 0x100))]


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in "".join(c if c in LETTERS else " " for c in text or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = plain_words(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def test_runs_are_damaged_as_stated():
    text = "Ünïted ÀÉ×÷ß straße x_y naïve's " + " ".join("word" + "abcdefghij"[i % 10] * (i % 7) for i in range(300))
    for key in ("", "1", "-9"):
        expected = Counter()
        for run in "".join(c if c in LETTERS else " " for c in text).split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            expected[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
        assert runs(key, text) == Counter({w.encode(): c for w, c in expected.items()})


def test_pieces_end_between_words(monkeypatch):
    text = " ".join(["straße", "naïve", "ééé", "x"] * 200) + " 中文 " + "ü" * 500
    whole = runs("1", text)
    for size in (1, 7, 64):
        monkeypatch.setattr(spelling, "PIECE", size)
        assert runs("1", text) == whole


@pytest.mark.parametrize("block", [50_000, 25, 3])
def test_near_words_equal_all_pairs(spark, block):
    rnd = random.Random(block)
    words = {"".join(rnd.choice("abÿ") for _ in range(rnd.choice([5, 5, 6, 7, 8]))) for _ in range(700)}
    words |= {"aaaaa" + "b" * i for i in range(12)} | {"z" * 3000, "z" * 3001, "y" + "z" * 2999}
    n = {w: rnd.randint(3, 9) for w in words}
    frame = written(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
    expected = {(a, b, n[b]) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    got = [tuple(r) for r in near_words(frame, block).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_scans_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SCANS", 7)
    monkeypatch.setattr(spelling, "CELLS", 50)
    test_near_words_equal_all_pairs(spark, 40)


def test_equals_plain_groups(spark, docs):
    rnd = random.Random(1)
    stems = ["color", "colour", "couleur", "centre", "center", "größe", "grosse", "Naïve", "naive", "ÉCOLE", "école"]
    texts = [" ".join(rnd.choice(stems) + rnd.choice(["", "", "s", "x", "ss"]) for _ in range(60)) for _ in range(40)]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (50, None), (51, ""), (52, "12 !? ab abcd"), (53, "tied0tied1 " * 2 + "tiedx tiedy " * 3)]
    frame = docs(rows)
    for name in ("word", "side", "m", "depth", "stem", "letters", "role", "back"):
        frame = frame.withColumn(name, F.lit("x")) if name not in frame.columns else frame
    got = [tuple(r) for r in group_variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_chain_of_forms(spark, docs):
    rows = [(-i, ("aaaaa" + "b" * i + " ") * 3 * 2**i) for i in range(7)]
    got = {tuple(r) for r in group_variants(docs(rows)).collect()}
    assert got == plain(rows) and len({r[2] for r in got}) <= 2


def test_no_words(spark, docs):
    assert group_variants(docs([])).count() == 0
    assert group_variants(docs([(1, None), (2, "one two")])).count() == 0
