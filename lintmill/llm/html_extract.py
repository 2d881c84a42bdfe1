"""Main text of HTML pages by the maximum-scoring run of segments.

A page is cut into tags and the words between them. A word scores positive, a
tag negative, and a word also takes the negative weights of the tags (name, and
name with each class) that enclose it. The weights are log odds of lying inside
or outside the content, counted over all labelled pages: those with a content
element, whose words inside it (less known boilerplate) are content. A linear
scan finds the contiguous region of the greatest sum.

The scores choose the region only. The text is that of the article it lies in, or else of the smallest element
around it that is more than a paragraph or a list (of the region itself where that is the page's body), without those elements
inside that are boilerplate: blocks whose classes or id outweigh a word, and known boilerplate of any kind. Links and
other inline elements are part of their block, whatever their tags weigh; blocks end at block elements alone.

Defined cases: a null or empty page has an empty text, as has one without a
word of positive score. A tag that the page's end cuts off is markup; a quote left open in a tag
ends with the tag, at the first ``>``. Of two regions of equal score the first counts. Repeated rows
give repeated results. Pages of any length and depth take linear time. A column named like the
result gives way to it; other columns stay.
An empty table gives an empty result; without labelled pages only the prior
weights count.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import BROADCAST_BYTES, fresh, written

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
TEXT = frozenset("blockquote dd dl dt figcaption h1 h2 h3 h4 h5 h6 li ol p pre table tbody td th tr ul".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp svg math object canvas audio video".split())
BOILER_TAGS = frozenset("nav header footer aside form button select option label menu dialog head title textarea".split())
BOILER_WORDS = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|discussion|footer|header|masthead|menu|nav|navbar|navigation|"
    r"newsletter|notice|pagination|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_ ])"
)
#: Words that a known boilerplate feature is taken to have been seen outside the content.
PRIOR = 1_000.0
#: Sums that a task holds before it passes them on.
COUNTED = 80_000
TAG_COST = -0.05
#: Words that a segment of boilerplate outweighs.
BRIDGE = 2

# A quoted value holds no tag and ends with a quote that the tag can go on or end after; any other quote is a character.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^"'>]+|"(?:[^"<]|<(?![a-zA-Z/!]))*"(?=[\s/>])|'(?:[^'<]|<(?![a-zA-Z/!]))*'(?=[\s/>])|["'])*)(?:>|\Z)""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def features_of(name: str, attributes: str) -> tuple[str, ...]:
    """The names under which a tag is counted: the element, and the element with each class, id and role."""
    if "=" not in attributes:
        return (name,)
    found = [name]
    for attribute, *values in _ATTRIBUTE.findall(attributes):
        for word in html.unescape("".join(values)).lower().split():
            found.append(f"{name}{'.' if attribute.lower() == 'class' else '#'}{word}")
    return tuple(found)


def is_boilerplate(feature: str) -> bool:
    name, _, word = feature.replace("#", ".").partition(".")
    return name in BOILER_TAGS if not word else name not in ("html", "body") and bool(BOILER_WORDS.search(word))


class Open:
    """An open element, with the one around it."""

    __slots__ = ("base", "block", "depth", "features", "full", "name", "parent", "plain")

    def __init__(self, name: str, features: tuple[str, ...], parent: Open | None):
        self.name, self.features, self.parent = name, features, parent
        self.depth = parent.depth + 1 if parent else 0
        # The nearest block element, this one or around it.
        self.block: Open | None = self if name in BLOCK else parent.block if parent else None


def segments(page: str) -> Iterator[tuple[str, str, tuple[str, ...], Open | None]]:
    """(kind, value, features, innermost open element); kind is text, block (a block boundary), tag (any other) or break.

    An element that opens is the innermost one of its own segment.
    """
    top: Open | None = None
    names: Counter = Counter()

    def closed(to: Open | None) -> Open | None:
        """Close all down to ``to`` and it as well."""
        nonlocal top
        while top is not to:
            names[top.name] -= 1
            top = top.parent
        names[top.name] -= 1
        top = top.parent
        return top

    at = 0
    while True:
        match = _TOKEN.search(page, at)
        end = match.start() if match else len(page)
        if end > at:
            yield "text", page[at:end], (), top
        if not match:
            return
        at = match.end()
        name = (match[1] or "").lower()
        if not name:
            continue
        if match[0].startswith("</"):
            if names[name]:
                place = top
                while place.name != name:  # these are closed as well, once each
                    place = place.parent
                closed(place)
            yield ("block" if name in BLOCK else "tag"), name, (), top
            continue
        if name in RAW and not match[2].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
            continue
        kind = "break" if name == "br" else "block" if name in BLOCK else "tag"
        if kind == "block" and top is not None and (near := top.block) is not None:
            # A block ends an open paragraph; an item ends the item before it.
            if near.name == "p" or (near.name == name and name in ("li", "dd", "dt", "tr", "td", "th", "option")):
                closed(near)
        features = features_of(name, match[2])
        if name not in VOID and not match[2].rstrip().endswith("/"):
            top = Open(name, features, top)
            names[name] += 1
        yield kind, name, features, top


def count_page(page: str, counts: Counter, content: str) -> None:
    """Adds a labelled page's words by feature: key (feature, inside or not). "" counts all words."""
    if f"<{content}" not in page.lower():
        return
    here: Open | None = None
    around: Counter = Counter()  # features of the open elements
    blamed: Counter = Counter()  # those of known boilerplate
    within = 0

    def enter(element: Open, by: int) -> None:
        nonlocal within
        within += by * (element.name == content)
        for feature in element.features:
            for counter in (around, *[blamed] * is_boilerplate(feature)):
                counter[feature] += by
                if not counter[feature]:
                    del counter[feature]

    for kind, value, _, top in segments(page):
        # Elements that were closed, then the one that was opened.
        while here is not None and here is not top and (top is None or here is not top.parent):
            enter(here, -1)
            here = here.parent
        if top is not here:
            enter(top, 1)
            here = top
        if kind != "text":
            continue
        words = len(value.split())
        if not words:
            continue
        # Known boilerplate explains its words; the elements around it are not blamed.
        inside = within > 0 and not blamed
        counts["", inside] += words
        for feature in blamed or around:
            counts[feature, inside] += words


def feature_sums(pages: DataFrame, column: str = "html", content: str = "article") -> DataFrame:
    """(feature, ins, outs): words inside and outside the content, of all features of all labelled pages. Tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"feature": [f for f, _ in counts], "inside": [i for _, i in counts], "n": list(counts.values())},
                pa.schema([("feature", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]),
            )

        for batch in batches:
            for page in batch.column(0).to_pylist():
                count_page(page or "", counts, content)
                if len(counts) > COUNTED:
                    yield rows()
                    counts.clear()
        yield rows()

    sums = pages.select(F.col(column).alias("html")).mapInArrow(run, "feature string, inside boolean, n long").groupBy("feature")
    return sums.agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("ins"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outs"))


def learn(pages: DataFrame, column: str = "html", content: str = "article") -> dict[str, float]:
    """Weights from all labelled pages: "" for a word, and each feature's negative weight. For as many features as the driver holds."""
    return weights_of({r["feature"]: (r["ins"], r["outs"]) for r in feature_sums(pages, column, content).toLocalIterator()})


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    def odds(inside: float, outside: float) -> float:
        return math.log((inside + 1.0) / (outside + 1.0))

    word = max(odds(*counts[""]) if "" in counts else 1.0, 0.5)
    weights = {"": word}
    for feature, (inside, outside) in counts.items():
        if feature and (weight := odds(inside, outside + PRIOR * is_boilerplate(feature))) < 0:
            weights[feature] = weight - word  # so that a word below it alone already scores negative
    return weights


def extract(page: str, weights: dict[str, float]) -> str:
    """The text around the best region."""
    word = weights[""]
    unseen = -math.log(PRIOR + 1) - word
    known: dict[str, float] = {}

    def cost(feature: str) -> float:
        if feature not in known:
            known[feature] = weights.get(feature, unseen if is_boilerplate(feature) else 0.0)
        return known[feature]

    parts: list[tuple[str, str, Open | None, Open | None]] = []  # the last: the element around all of the segment
    best, best_range, score, start = 0.0, (0, 0), 0.0, 0
    for kind, value, features, top in segments(page):
        own = sum(map(cost, features))
        opens = top is not None and top.features is features
        if opens:
            # Inline elements, and plain ones, count for the region, but are no reason to leave words of it out.
            above, block = top.parent, top.name in BLOCK
            named = sum(cost(f) for f in features if is_boilerplate(f) or (block and f != top.name))
            top.full = own + (above.full if above else 0.0)
            top.base = named + (above.base if above else 0.0)
            top.plain = min(cost(top.name), 0.0) * block + (above.plain if above else 0.0)
        if kind == "text":
            words = len(value.split())
            each = word + (top.full if top else 0.0)
            # Boilerplate inside the content is left out of the text; passing it costs a few words at most.
            gain = words * each if each > 0 else max(words * each, -BRIDGE * word)
        else:
            gain = TAG_COST + max(own, -word)
        parts.append((kind, value, top, top.parent if opens else top))
        if score <= 0:
            score, start = 0.0, len(parts) - 1
        score += gain
        if score > best:
            best, best_range = score, (start, len(parts))
    first, last, sure = _element_around(parts, *best_range)
    blocks, line = [], []
    for i in range(first, last):
        kind, value, top, _ = parts[i]
        if kind == "text":
            # Around a region that is not in an article, plain blocks count as well.
            near = sure or best_range[0] <= i < best_range[1]
            if top is None or word + top.base + (0.0 if near else top.plain) > 0:
                line.append(html.unescape(value))
        elif kind == "break":
            line.append(" ")
        elif kind == "block":
            blocks.append("".join(line))
            line = []
    blocks.append("".join(line))
    return "\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def _element_around(parts: list[tuple[str, str, Open | None, Open | None]], first: int, last: int) -> tuple[int, int, bool]:
    """The range of the smallest block element that holds the words of the range, and whether that is an article; the range itself if it is the body or none."""
    texts = [i for i in range(first, last) if parts[i][0] == "text" and not parts[i][1].isspace()]
    if not texts:
        return first, last, False
    # Of the elements around the segments from the first word to the last, the outermost holds all.
    held = [parts[i][3] for i in range(texts[0], texts[-1] + 1)]
    around = None if None in held else min(held, key=lambda e: e.depth).block
    if around is None or around.name in ("html", "body"):
        return first, last, False
    # One paragraph or item stands for what it is part of, and a part of an article for the article.
    while around.name in TEXT and around.parent and (outer := around.parent.block) and outer.name not in ("html", "body"):
        around = outer
    element: Open | None = around
    while element is not None and element.name != "article":
        element = element.parent
    around = element or around
    inside = lambda top: top is not None and (top is around or top.depth > around.depth)
    while first > 0 and inside(parts[first - 1][2]):
        first -= 1
    while last < len(parts) and inside(parts[last][2]):
        last += 1
    return first, last, element is not None


def _with_weights(pages: DataFrame, column: str, sums: DataFrame, to: str) -> DataFrame:
    """The rows with ``to``: the sums of all features that the page has, by joins."""
    # Pages are told apart by their content, as equal pages have equal features.
    digest = F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for _, _, names, _ in segments(page or "") for f in names}) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["digest", "features"])

    met = pages.select(digest.alias("digest"), F.col(column)).mapInArrow(run, "digest binary, features array<string>")
    met = met.select("digest", F.explode("features").alias("feature")).distinct().join(sums, "feature")
    own = written(met.groupBy("digest").agg(F.collect_list(F.struct("feature", "ins", "outs")).alias(to)), "page_features")
    key = fresh(pages, "_digest")
    return pages.withColumn(key, digest).join(own.withColumnRenamed("digest", key), key, "left").drop(key)


def extract_text(pages: DataFrame, column: str = "html", to: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """The rows without the page but with its text; weights are learned from ``pages`` unless given.

    Learned sums are a written table. Measured small they are broadcast, else each page meets those of its features by joins.
    """
    names = [c for c in pages.columns if c not in (column, to)]
    slim, total, sums = pages.select(*names, F.col(column)), {}, None
    if weights is None:
        sums = written(feature_sums(pages, column), "page_feature_sums")
        if (sums.agg(F.sum(F.octet_length("feature") + 100)).first()[0] or 0) <= BROADCAST_BYTES:
            weights = weights_of({r["feature"]: (r["ins"], r["outs"]) for r in sums.collect()})
    if weights is None:
        total = {r["feature"]: (r["ins"], r["outs"]) for r in sums.where("feature = ''").collect()}
        slim = _with_weights(slim, column, sums, fresh(slim, "_sums"))
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # below BROADCAST_BYTES, or none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(names)).to_pylist()
            if shared.value is None:
                own = [weights_of(total | {x["feature"]: (x["ins"], x["outs"]) for x in found or ()}) for found in batch.column(len(names) + 1).to_pylist()]
            else:
                own = [shared.value] * len(values)
            texts = [extract(page or "", w) for page, w in zip(values, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], [*names, to])

    schema = ", ".join([*(f"`{c}` {dict(pages.dtypes)[c]}" for c in names), f"`{to}` string"])
    return slim.mapInArrow(run, schema)
