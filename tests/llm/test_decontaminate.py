import random

from lintmill.llm import common, decontaminate
from lintmill.llm.decontaminate import covered, drop_contaminated, find_hits


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c > "\x7f" or c.isdigit() or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(docs, items, window):
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(len(w), window)
        for s in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (x := tuple(w[s : s + size])) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[x]
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def check(spark, docs, rows, items, window):
    found = find_hits(docs(rows), spark.createDataFrame(items, "item_id long, text string"), window=window)
    got = found.select("doc_id", "n_words", covered(found["hits"]).alias("n"), "item_ids").collect()
    assert sorted((str(r.doc_id), r.n_words, r.n, list(r.item_ids)) for r in got) == brute(rows, items, window)


def test_against_brute_force(spark, docs, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, text(40)), (9, "b " * 5000)]
    items = [(i, text(rng.randint(0, 14))) for i in range(40)] + [(50, None), (51, "A"), (51, "A"), (52, "..")]
    check(spark, docs, rows, items, 10)
    # The same in many blocks of the prefix table.
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 4000)
    check(spark, docs, rows, items, 10)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", common.BROADCAST_BYTES)


def test_no_items_and_no_documents(spark, docs):
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert find_hits(docs([]), items).count() == 0
    assert [list(r.item_ids) for r in find_hits(docs([(1, "x y z")]), items.where("false")).collect()] == [[]]


def test_dropping_keeps_clean_rows_and_columns(spark, docs):
    passage = " ".join(f"p{i}" for i in range(12))
    frame = docs([(1, f"before {passage} after"), (2, "clean " * 20), (2, "clean " * 20), (3, None), (4, passage[:-10])])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = drop_contaminated(frame, items)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3, 4]
