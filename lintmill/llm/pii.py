"""Personal data by patterns, and terms that give protected entities away.

Base spans are found by pattern: e-mail addresses, IP addresses, card numbers
and telephone numbers. Every distinct value found is a protected entity. Terms
are the words of an entity's documents outside all base spans. Everything is
counted over distinct texts: copies of a text tell nothing new, equal
neighbourhoods in different texts do. A term reveals an entity if they occur
together in at least MIN_TOGETHER texts, or in half of the entity's texts (and
two) where those are fewer, and the term removes at least DISCLOSURE of the
entity's information: log(p(e, t) / (p(e) p(t))) / -log p(e). It becomes a
further span wherever it occurs in the entity's documents. Sanitising
generalises base spans to their kind and terms to ``number`` or ``name``, and
removes other terms.

As p(e, t) <= p(e), a term passes only if its own texts number at most
n (mentions / n) ** DISCLOSURE, and no fewer than it must share with the entity:
words outside these limits are dropped before pairs are made, without a change
of the result.

Defined cases: a null text counts as empty and stays null. An entity of a single
text has no terms: every rare word of that text would pass. Documents of equal
text are told apart by their keys; repeated keys and texts share one set of
spans. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import broadcast_if_small, fresh, key_of, written

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "term")
MIN_TOGETHER = 5
DISCLOSURE = 0.8
#: Words that a task counts before it passes its sums on.
COUNTED = 500_000

# Fixed patterns. Where a plain search could start again inside a run of digits
# and fail there too, a look-behind says so; addresses are searched from their @.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of personal data, by start and kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", a, b) for a, b in _emails(text)]
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", match.start(), match.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def entity_of(text: str, span: Span) -> str:
    """The protected value, without the marks that numbers may be written with."""
    kind, start, end = span
    value = re.sub(r"[ ().-]", "", text[start:end]) if kind in ("card", "phone") else text[start:end]
    return f"{kind}:{value.lower()}"


def near_terms(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the text's words of two characters or more that meet none of the sorted ``spans``."""
    at, reach = 0, 0
    for match in _WORD.finditer(text):
        start, end = match.span()
        while at < len(spans) and spans[at][1] < end:
            reach = max(reach, spans[at][2])
            at += 1
        if end - start > 1 and reach <= start:
            yield match[0].lower(), start, end


def kind_place(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_SPANS = "array<struct<start:int,end:int,kind:string>>"
_FOUND = [("spans", pa.list_(_SPAN)), ("entities", pa.list_(pa.string())), ("word", pa.string()), ("n", pa.int64())]
FOUND = f"key string, digest binary, copies long, spans {_SPANS}, entities array<string>, word string, n long"


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def scan(docs: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """A row (keys, key, digest, copies, spans, entities) for each text; further rows (word, copies, n) say in how many texts with so many copies a word occurs.

    One pass does both. A task sums its words before it passes them on.
    """
    slim = docs.select(*keys, key_of(*[F.col(k) for k in keys], F.col(text)).alias("key"), digest_of(F.col(text)).alias("digest"), F.col(text).alias("_text"))
    copies = written(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "pii_copies")
    slim = slim.join(broadcast_if_small(copies, 64), "digest", "left").select(*keys, "key", "digest", F.coalesce("copies", F.lit(1)).alias("copies"), "_text")
    own = len(keys) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        fields: list[pa.Field] = []

        def sums() -> pa.RecordBatch:
            words = pa.array([w for c in counts.values() for w in c], pa.string())
            numbers = pa.array([n for c in counts.values() for n in c.values()], pa.int64())
            of = pa.array([k for k, c in counts.items() for _ in c], pa.int64())
            counts.clear()
            nulls = [pa.nulls(len(words), f.type) for f in fields[:-2]]
            nulls[own - 1] = of
            return pa.RecordBatch.from_arrays([*nulls, words, numbers], schema=pa.schema(fields))

        for batch in batches:
            fields = [*(batch.schema.field(i).with_nullable(True) for i in range(own)), *(pa.field(*f) for f in _FOUND)]
            all_spans, all_entities = [], []
            for value, of in zip(batch.column(own).to_pylist(), batch.column(own - 1).to_pylist(), strict=True):
                value = value or ""
                spans = base_spans(value)
                words = {t for t, _, _ in near_terms(value, spans)} if spans else {w.lower() for w in set(_WORD.findall(value)) if len(w) > 1}
                all_spans.append([{"start": a, "end": b, "kind": k} for k, a, b in spans])
                all_entities.append(sorted({entity_of(value, s) for s in spans}))
                counts.setdefault(of, Counter()).update(words)
                if sum(map(len, counts.values())) > COUNTED:
                    yield sums()
            n = batch.num_rows
            arrays = [pa.array(all_spans, _FOUND[0][1]), pa.array(all_entities, _FOUND[1][1]), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *arrays], schema=pa.schema(fields))
        if counts:
            yield sums()

    types = dict(docs.dtypes)
    return slim.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), FOUND]))


def _terms(docs: DataFrame) -> DataFrame:
    """(digest, terms): the distinct terms of each text of ``docs(digest, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t for t, _, _ in near_terms(x, base_spans(x))}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], ["digest", "terms"])

    return docs.mapInArrow(run, "digest binary, terms array<string>")


def _occurrences(docs: DataFrame) -> DataFrame:
    """(key, added): the places of the ``terms`` in each text of ``docs(key, text, terms)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wanted = set(terms)
                found.append([{"start": a, "end": b, "kind": "term"} for t, a, b in near_terms(value, base_spans(value)) if t in wanted])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], ["key", "added"])

    return docs.mapInArrow(run, f"key string, added {_SPANS}")


def disclosing(docs: DataFrame, scanned: DataFrame, together: int = MIN_TOGETHER, disclosure: float = DISCLOSURE) -> DataFrame:
    """(digest, terms): of each text of ``docs(key, digest, text)`` the terms that reveal one of its entities, from counts over all distinct texts."""
    rows = scanned.where("word is null")
    n = rows.agg(F.sum(F.when(F.col("copies") == 1, 1))).first()[0] or 0
    n += rows.where("copies > 1").select("digest").distinct().count()
    met = written(rows.where(F.size("entities") > 0).select("digest", F.explode("entities").alias("entity")).distinct(), "pii_met")
    mentions = written(met.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions")).where((F.col("mentions") > 1) & (F.col("mentions") < n)), "pii_mentions")
    size = F.octet_length("entity") + 48
    # Only entities of several texts count further, and only the texts that hold one are read again, each once.
    met = written(met.join(broadcast_if_small(mentions, size), "entity"), "pii_entities")
    keys = rows.join(met.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("key").alias("key"))
    keys = broadcast_if_small(written(keys.select("key"), "pii_holders"), 64)
    held = written(_terms(docs.join(keys, "key", "left_semi").select("digest", "text")).dropDuplicates(["digest"]), "pii_held")
    beside = held.select("digest", F.explode("terms").alias("term"))
    names = broadcast_if_small(written(beside.select("term").distinct(), "pii_terms"), F.octet_length("term") + 32)
    # Every text of so many copies was counted as often.
    counted = scanned.where("word is not null").join(names, F.col("word") == F.col("term")).groupBy("term", "copies").agg(F.sum("n").alias("n"))
    texts = counted.groupBy("term").agg(F.sum(F.expr("n div copies")).alias("texts")).where("texts > 1")
    texts = broadcast_if_small(written(texts, "pii_texts"), F.octet_length("term") + 40)
    need = F.least(F.lit(together), F.greatest(F.lit(2), F.ceil(F.col("mentions") / 2)))
    most = n * F.pow(F.col("mentions") / n, F.lit(disclosure))
    able = (F.col("texts") >= need) & (F.col("texts") <= most * (1 + 1e-9))
    pairs = beside.join(texts, "term").join(broadcast_if_small(met, size + 16), "digest").where(able)
    pairs = pairs.groupBy("entity", "term", "mentions", "texts").agg(F.count(F.lit(1)).alias("both"))
    shared = F.log(F.col("both") * F.lit(float(n)) / (F.col("mentions") * F.col("texts")))
    passed = (F.col("both") >= need) & (shared >= disclosure * -F.log(F.col("mentions") / n))
    revealing = written(pairs.where(passed).select("entity", "term"), "pii_revealing")
    lists = written(revealing.groupBy("entity").agg(F.collect_list("term").alias("terms")), "pii_lists")
    lists = broadcast_if_small(lists, F.octet_length("entity") + F.octet_length(F.array_join("terms", " ")) + 96)
    return met.join(lists, "entity").groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms"))


def find_spans(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), **limits: float) -> DataFrame:
    """``keys``, ``key`` (a digest of keys and text) and ``spans`` array<struct<start,end,kind>> of every row, sorted."""
    renamed = docs.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col(text).alias("text"))
    own = tuple(f"k_{k}" for k in keys)
    scanned = written(scan(renamed, "text", own), "pii_scan")
    slim = renamed.select(key_of(*[F.col(k) for k in own], F.col("text")).alias("key"), digest_of(F.col("text")).alias("digest"), "text")
    revealing = written(disclosing(slim, scanned, **limits), "pii_disclosing")
    revealing = broadcast_if_small(revealing, F.octet_length(F.array_join("terms", " ")) + F.size("terms") * 16 + 96)
    rows = scanned.where("word is null")
    added = written(_occurrences(slim.join(revealing, "digest").select("key", "text", "terms")).where(F.size("added") > 0).dropDuplicates(["key"]), "pii_added")
    added = broadcast_if_small(added, F.size("added") * 40 + 96)
    both = F.concat("spans", F.coalesce("added", F.array().cast(_SPANS)))
    ordered = F.transform(both, lambda s: F.struct(s["start"].alias("start"), kind_place(s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.sort_array(ordered), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.join(added, "key", "left").select(*[F.col(f"k_{k}").alias(k) for k in keys], "key", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str, spans: list[Span]) -> str:
    """The text with spans generalised; of overlapping spans the first, then the longest, gives the kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        value = text[start:end]
        label = kind if kind != "term" else "number" if value.isdigit() else "name" if value[:1].isupper() else ""
        out += [text[at:start], f"<{label}>" if label else ""]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), **limits: float) -> DataFrame:
    """The rows of ``docs`` with the text sanitised; rows without spans don't move unless there are many with."""
    key, spans = fresh(docs, "_key"), fresh(docs, "_spans")
    found = find_spans(docs, text, keys, **limits).where(F.size("spans") > 0)
    found = written(found.dropDuplicates(["key"]).select(F.col("key").alias(key), F.col("spans").alias(spans)), "pii_spans")
    found = broadcast_if_small(found, F.size(spans) * 40 + 96)
    joined = docs.join(found, key_of(*[F.col(k) for k in keys], F.col(text)) == F.col(key), "left").drop(key)
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(len(names)).to_pylist(), batch.column(place)
            if any(spans):
                values = [masked(t, [(s["kind"], s["start"], s["end"]) for s in x]) if x and t is not None else t for t, x in zip(texts.to_pylist(), spans, strict=True)]
                texts = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], texts, *batch.columns[place + 1 : len(names)]], names)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return joined.mapInArrow(run, schema)
