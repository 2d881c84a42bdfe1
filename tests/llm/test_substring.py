import random

from lintmill.llm.substring_dedup import ANCHOR, WINDOW, find_repeats, remove_repeats, words_in

rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def flags(frame):
    found = find_repeats(frame)
    rows = found.select("id", words_in(found["repeated"]).alias("repeated"), words_in(found["removed"]).alias("removed")).collect()
    return {r.id: (r.repeated, r.removed) for r in rows}


def test_passages_copies_and_clean_documents(docs):
    passage, line = text(ANCHOR + WINDOW - 1), text(30)
    near = line.split()
    near[29] = "zz"
    rows = [(i, text(40) + " " + passage + " " + text(rng.randint(5, 60))) for i in range(5)]
    rows += [(10, f"{text(40)}\n{line}\n{text(9)}"), (11, f"{' '.join(near)}\n{text(50)}"), (20, text(200)), (21, text(200)), (22, f"{text(30)}\n{text(8)}")]
    copy = f"{text(60)}\n{text(70)}"
    rows += [(30, copy), (31, copy), (40, f"{line[:20]}\n" * 5)]
    got = flags(docs(rows))
    for i in range(5):
        assert got[i][0] >= WINDOW and (got[i][1] == 0) == (i == 0)
    assert got[10] == (30, 0) and got[11] == (30, 30)
    assert got[20] == got[21] == got[22] == got[40] == (0, 0)
    assert got[30][1] == 0 and got[31][1] == 130


def test_every_long_passage_shares_a_window(docs):
    rows, expected = [], set()
    for k in range(60):
        passage = text(ANCHOR + WINDOW - 1)
        for d in range(2):
            rows.append((2 * k + d, f"{text(rng.randint(0, 30))} {passage} {text(rng.randint(0, 30))}"))
            expected.add(2 * k + d)
    got = flags(docs(rows))
    assert {i for i, (repeated, _) in got.items() if repeated} == expected


def test_removal(docs):
    passage = text(60)
    frame = docs([(1, f"Start here.\n{passage}\nEnd one."), (2, f"Other start. é\n{passage.upper()}\nEnd two."), (3, None)])
    texts = {r.doc_id: r.text for r in remove_repeats(frame).collect()}
    assert texts == {1: f"Start here.\n{passage}\nEnd one.", 2: "Other start. é\n\nEnd two.", 3: None}
    assert remove_repeats(frame).columns == frame.columns


def test_odd_rows(docs):
    whole = text(70)
    frame = docs([(1, None), (2, ""), (3, "few words"), (None, whole), (4, whole), (4, whole), (5, "w " * 50_000)])
    got = sorted((str(r.id), r.n_words, [tuple(s) for s in r.removed]) for r in find_repeats(frame).collect() if r.id != 5)
    assert got == sorted([("1", 0, []), ("2", 0, []), ("3", 2, []), ("4", 70, []), ("4", 70, []), ("None", 70, [(0, 70)])])
    assert find_repeats(docs([])).count() == remove_repeats(docs([])).count() == 0


def test_query_finds_all_long_repeats(spark, given):
    from lintmill.llm.queries import op2_substring_dedup

    places = {}
    for row in spark.read.parquet(f"{given}/documents.parquet").collect():
        words = (row.text or "").encode().lower().split()
        for at in range(len(words) - 50):
            places.setdefault(tuple(words[at : at + 51]), set()).add(row.doc_id)
    expected = set().union(*[p for p in places.values() if len(p) > 1])
    found = op2_substring_dedup(spark, given).collect()
    assert expected and expected <= {r.doc_id for r in found if r.repeats}
    assert len(found) == spark.read.parquet(f"{given}/documents.parquet").count()


def test_short_lines_and_short_texts(docs):
    song = [text(6) for _ in range(8)]
    near = [*song[:7], song[7] + " zz"]
    rows = [(1, "one two three"), (2, "One two  three"), (3, "one two four"), (4, text(17)), (6, "\n".join(song)), (7, "\n".join(near))]
    rows += [(5, rows[3][1]), (8, f"{text(25)}\n" + "\n".join(song[:4]) + f"\n{text(25)}")]
    got = flags(docs(rows))
    assert got[1] == (3, 0) and got[2] == (3, 3) and got[3] == (0, 0)
    assert got[4] == (17, 0) and got[5] == (17, 17)
    assert got[6] == (48, 0) and got[7][1] >= 48 and got[8] == (24, 24)


def test_recall_against_all_pairs(docs):
    """Paragraphs at all similarities around 0.8, every pair compared by its exact Jaccard similarity."""
    from lintmill.llm.substring_dedup import MIN_WORDS, PERCENT, SHINGLE

    local = random.Random(9)
    rows = []
    for _ in range(200):
        words = [local.choice(WORDS) for _ in range(local.randint(MIN_WORDS, 60))]
        for _ in range(local.randint(2, 5)):
            near = list(words)
            for _ in range(local.randint(0, 3)):
                near[local.randrange(len(near))] = local.choice(WORDS)
            rows.append((len(rows), " ".join(near)))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append(frozenset(tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))
    expected = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(a & b) >= PERCENT * len(a | b)}
    whole = {r.id for r in find_repeats(docs(rows)).collect() if [(0, r.n_words)] == [tuple(s) for s in r.repeated]}
    assert len(expected) > 60 and len(expected & whole) >= 0.95 * len(expected) and whole <= expected
