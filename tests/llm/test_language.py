import math
import random
import zlib
from collections import Counter

from lintmill.llm import language_id
from lintmill.llm.language_id import ORDER, identify, train
from lintmill.llm.queries import op6_language_id

ROWS = [("en", "the cat sat on the mat"), ("en", "that that"), ("fr", "le chat est là"), ("fr", "élan le")]


def plain_bits(texts, text):
    counts = Counter()
    for t in texts:
        data = bytes(ORDER) + t.encode()
        counts.update((data[i - k : i], data[i]) for i in range(ORDER, len(data)) for k in range(ORDER + 1))
    data, bits = bytes(ORDER) + text.encode(), 0.0
    for i in range(ORDER, len(data)):
        for k in range(ORDER, -1, -1):
            seen = {s: n for (c, s), n in counts.items() if c == data[i - k : i]}
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / total)
                break
            bits -= math.log2(len(seen) / total) if seen else 0
        else:
            bits += 8
    return bits


TEXTS = ["the chat", "zzz", "", "là que that", "é", "\0"]


def test_code_lengths_are_exact(spark):
    learned = train(spark.createDataFrame([*ROWS, (None, "xx"), ("de", None)], "lang string, text string"))
    model = learned.model()
    assert model.langs == learned.langs == ["en", "fr"]
    for text, bits in zip(TEXTS, model.code_lengths([t.encode() for t in TEXTS]), strict=True):
        for lang, got in zip(model.langs, bits, strict=True):
            assert math.isclose(got, plain_bits([t for n, t in ROWS if n == lang], text), rel_tol=1e-5, abs_tol=1e-6)


def test_nothing_is_left_out_of_a_large_model(spark, docs, monkeypatch):
    """A model that is not sent to the tasks gives every text the same language and score."""
    rnd = random.Random(3)
    rows = [(lang, " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(30))) for lang, letters in (("en", "abcde"), ("fr", "cdefgé"), ("zh", "中文字abc")) for _ in range(20)]
    learned = train(spark.createDataFrame(rows, "lang string, text string"))
    frame = docs([(i, t) for i, t in enumerate([*TEXTS, None, "42 !?", *(t for _, t in rows), "abc xyz ÿÿ 中", "dé " * 3000])])
    whole = {r.doc_id: (r.lang_pred, r.score) for r in identify(frame, learned).collect()}
    for size in (1, 2000, 1 << 20):
        monkeypatch.setattr(language_id, "CHUNK_BYTES", size)
        parts = {r.doc_id: (r.lang_pred, r.score) for r in identify(frame, learned, pairs=0).collect()}
        assert parts.keys() == whole.keys() and all(parts[i][0] == whole[i][0] and math.isclose(parts[i][1], whole[i][1], rel_tol=1e-6) for i in whole)


def test_odd_rows(spark, docs):
    model = train(spark.createDataFrame(ROWS, "lang string, text string"))
    frame = docs([(1, None), (2, ""), (3, "12 !?"), (4, "the the mat"), (4, "the the mat"), (None, "le chat là"), (5, "the cat " * 100_000)])
    got = sorted((str(r.doc_id), r.lang_pred, 0 <= r.score <= 1) for r in identify(frame, model).collect())
    assert got == sorted([("1", "und", True), ("2", "und", True), ("3", "und", True), ("4", "en", True), ("4", "en", True), ("None", "fr", True), ("5", "en", True)])
    empty = docs([])
    assert identify(empty, train(empty)).count() == 0
    assert {r.lang_pred for r in identify(frame, train(empty)).collect()} == {"und"}


def test_held_out_accuracy(spark, given):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{given}/documents.parquet").collect()}
    rows = op6_language_id(spark, given).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(rows) == len(langs)
    held = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
