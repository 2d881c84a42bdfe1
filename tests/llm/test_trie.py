import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lintmill.llm import prefix_trie
from lintmill.llm.common import written
from lintmill.llm.prefix_trie import hash_turns, ids_digests, maybe_shared, rebuild, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """All nodes, from lists of every prefix."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in by.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = Counter(), {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * len(node[-1][1] if node else "") + sum(saved[x] for x in children[node])
        ends = ",".join(str(c) for c in members[node] if len(rebuilt[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out[(members[node][0], len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def found(frame, width=None):
    conv = F.col("conv")
    turns = hash_turns(frame)
    nodes = trie(*rebuild(turns, F.crc32(conv.cast("string").cast("binary")) % 6, conv - conv % 100), width)
    assert nodes.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in nodes.collect())


def given_rows():
    rnd = random.Random(3)
    rows = [
        (c, rnd.choice([t, t, t, None, 1]), rnd.choice(["user", "bot", None]), rnd.choice(["a", "bé\U0001f600", "ccc", "", None]))
        for c in [*range(250), -1, -100, -150, 1000]
        for t in range(rnd.randint(1, 7))
    ]
    # Two long equal conversations, one that ends inside them, a row of none, and repeated rows.
    rows += [(c, t, "u", f"x{t % 3}") for c, n in ((300, 300), (400, 300), (500, 120)) for t in range(n)]
    return [*rows, (None, 1, "u", "t"), *[(5, 0, "u", "a")] * 3]


@pytest.mark.parametrize("width", [None, 16])
def test_equals_all_prefixes(spark, width):
    rows = given_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("conv", "place", "before", "after", "n", "part", "node", "size", "unit", "h1"):
        frame = frame.withColumn(name, F.lit("x"))
    assert found(frame, width) == plain(rows)


def test_conversation_over_many_ranges(spark, monkeypatch):
    """A hot conversation lies in several ranges, its tail in several stretches."""
    monkeypatch.setattr(prefix_trie, "LEVELS", 100)
    rows = [(7, t, "u", f"t{t}") for t in range(3000)] + [(c, t, "u", f"t{t}") for c in (8, 9) for t in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert hash_turns(frame).where("conv = 7").count() == 3000
        assert found(frame) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversations(spark):
    rows = [(None, 1, "u", "t")]
    assert not found(spark.createDataFrame(rows, SCHEMA)) and not found(spark.createDataFrame([], SCHEMA))
    rows = [(3, None, None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_long_text(spark):
    rows = [(c, 1, "user", "é" * 2_000_000) for c in (1, 2)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_sketch_never_counts_too_little(spark):
    rows = [(c, t, "u", f"{c % 40}:{t}") for c in range(80) for t in range(4)]
    prefixes = written(hash_turns(spark.createDataFrame(rows, SCHEMA)), "x")
    for width in (64, 1 << 16):
        kept = Counter(r.after for r in maybe_shared(prefixes, width).collect())
        many = Counter(r.after for r in prefixes.collect())
        assert all(kept[d] == n for d, n in many.items() if n > 1)
    assert sum(kept.values()) == sum(n for n in many.values() if n > 1) == 320


def test_hot_list_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 100)
    ids = [*range(-50, 5000), 10**12]
    ends = spark.createDataFrame([(b"a", c) for c in ids] + [(b"b", 3)], "node binary, conv long").repartition(7)
    got = {bytes(r.node): r.ends_sha256 for r in ids_digests(ends).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b": hashlib.sha256(b"3").hexdigest()}
