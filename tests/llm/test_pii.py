import hashlib
import random
import re

from lintmill.llm.pii import base_spans, find_spans, near_terms, sanitise
from lintmill.llm.queries import op8_pii

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        odd, even = digits[-1::-2], digits[-2::-2]
        return 12 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(int(c) for d in even for c in str(2 * int(d)))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in p.finditer(text) if valid(kind, m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_spans_against_plain_patterns():
    rng = random.Random(3)
    parts = list("ab1294.@@+-() %_\n") + ["4111 1111 1111 1111", "10.0.0.1", "+1 (212) 555-0100", "a@b.co", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "a@" * 150_000, "+1" + "(" * 300_000, "1." * 150_000):
        base_spans(text)
    text = "x" * 200_000 + " a@b.co " + "y" * 200_000
    near_terms(text, base_spans(text))


def test_a_term_that_gives_an_entity_away(spark):
    rows = [(i, f"w{i} call Zorbas the v{i} at zed@corp.com or u{i}") for i in range(6)]
    rows += [(100 + i, f"the plain text number {i} call or at") for i in range(60)]
    rows += [(200 + i, "copy Mirto of 10.1.2.3 here") for i in range(9)]  # copies tell nothing new
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in sanitise(frame).collect()}
    assert texts[0] == "w0 call <name> the v0 at <email> or u0" and texts[100] == rows[6][1] and texts[200] == "copy Mirto of <ip> here"
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in find_spans(frame).collect()}
    assert found[0] == [(8, 14, "term"), (25, 37, "email")] and found[100] == []


def test_odd_rows(docs):
    frame = docs([(1, "mail bob@x.com now"), (1, "mail bob@x.com now"), (2, None), (3, ""), (None, "id 10.0.0.1"), (4, "é bob@x.com")])
    result = sanitise(frame)
    assert result.columns == frame.columns
    assert sorted(map(str, (r.text for r in result.collect()))) == ["", "None", "id <ip>", "mail <email> now", "mail <email> now", "é <email>"]
    assert find_spans(frame).count() == 6 and find_spans(docs([])).count() == sanitise(docs([])).count() == 0


def test_query_against_plain_patterns(spark, given):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{given}/documents.parquet").collect()}
    for row in op8_pii(spark, given).collect():
        spans = brute(texts[row.doc_id])
        joined = ["%s:%d:%d" % s for s in spans]
        assert row.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k, _ in PATTERNS]
        assert set(joined) <= set(row.spans.split(",")) | {""}


def test_one_signature_in_many_documents(spark):
    rows = [(i, f"text a{i} of b{i}. Kind regards Janedoe jane@corp.com") for i in range(40)]
    rows += [(100 + i, f"plain c{i} text of kind regards d{i}") for i in range(400)]
    texts = {r.doc_id: r.text for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts[3] == "text a3 of b3. Kind regards <name> <email>" and texts[103] == rows[43][1]


def test_copies_switch_nothing_off(spark):
    rows = [(i, f"see a{i} Zorbas b{i} zed@corp.com") for i in range(6)] + [(1000 + i, "see a0 Zorbas b0 zed@corp.com") for i in range(300)]
    rows += [(5000 + i, f"see other c{i} text") for i in range(500)]
    texts = {r.doc_id: r.text for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts[1] == "see a1 <name> b1 <email>" and texts[0] == texts[1299] == "see a0 <name> b0 <email>"


def test_terms_anywhere_in_the_documents_of_a_rare_entity(spark, docs, given):
    import corpus_pipeline

    far = [" ".join(f"x{i}y{k}" for k in range(40)) for i in range(2)]
    rows = [(i, f"Zorbas leads. {far[i]} mail zed@corp.com. {far[i]} so Zorbas again, quelled") for i in range(2)]
    rows += [(100 + i, f"leads mail so again number{i}") for i in range(300)] + [(500 + i, f"quelled number{i}") for i in range(40)]
    frame = docs(rows)
    texts = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["pii"](spark, frame, given).collect()}
    for i in range(2):
        assert texts[i] == f"<name> leads. {far[i]} mail <email>. {far[i]} so <name> again, quelled"
    assert all(texts[i] == t for i, t in rows[2:])


def test_words_beside_spans_of_all_shapes():
    text = "éa@b.co xx 10.0.0.1 yy a x@y.zz"
    assert list(near_terms(text, base_spans(text))) == [("xx", 8, 10), ("yy", 20, 22)]
