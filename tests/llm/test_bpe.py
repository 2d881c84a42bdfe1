import random

import public_tokenizers
import pytest
import tiktoken

from lintmill.llm.bpe import Bpe, read_ranks

RANKS = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "9", "'s", "'", "ll", "!", "...", "\x1c", "\x85", "\xa0", "\u3000", "\U0001f600", "ñ", "中", "²", "\u0301", "\r\n", "<|endoftext|>"]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 10), (16, 16), (100_000, 5)])
def test_same_ids_as_the_plain_encoder(spark, docs, chunk, overlap):
    rng = random.Random(chunk)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    # Runs without a seam, null, empty and repeated rows.
    rows += [(1000, None), (1001, ""), (1002, "x" * 500), (1003, " " * 333), (1004, " " * 333 + "y"), (1, "dup" * 60), (1, "dup" * 60), (None, "no id " * 30)]
    coder = Bpe(spark, RANKS, public_tokenizers.PATTERN, chunk, overlap)
    frame = docs(rows)
    found = coder.encode(frame, back=True)
    assert found.columns == [*[c for c in frame.columns if c != "text"], "ids", "decoded"]
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in found.collect())
    assert got == sorted((str(i), PLAIN.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    again = coder.decode(coder.encode(frame, keys=["doc_id"])).select("decoded").collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted((t or "").encode() for _, t in rows)


def test_empty_table(spark, docs):
    assert Bpe(spark, RANKS, public_tokenizers.PATTERN).encode(docs([]), back=True).count() == 0


def test_query_against_the_plain_encoder(spark, given):
    import hashlib

    from lintmill.llm.queries import op5_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{given}/documents.parquet").collect()}
    for row in op5_byte_bpe(spark, given).collect():
        ids = PLAIN.encode_ordinary(texts[row.doc_id] or "")
        joined = ",".join(map(str, ids)).encode()
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(joined).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()
