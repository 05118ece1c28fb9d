"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags.  A block's features are its
word count and link density and those of the blocks before and after it, what
the nearest telling element around it is (article or clutter), and whether it
is a heading.  A decision tree (Spark ML), trained on the small labelled table
below, keeps or drops each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import slices

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "context", "heading")

#: Labelled blocks: the features in order (links: share of words inside links; context: 1 in the article,
#: -1 in clutter, 0 neither), then 1 for main text.
LABELLED = """
60 0.00 1 0.0 80 0.00 1 0 1 | 8 0.00 4 1.0 60 0.00 1 1 1 | 3 0.00 40 0.0 35 0.00 1 0 1 | 1 0.00 90 0.0 2 0.00 1 0 1
25 0.10 8 0.0 40 0.05 1 0 1 | 120 0.02 30 0.0 0 0.0 1 0 1 | 12 0.00 70 0.1 15 0.00 1 0 1 | 40 0.30 25 0.0 22 0.0 1 0 1
5 0.00 0 0.0 6 0.00 1 0 1 | 2 0.00 3 0.0 4 1.00 1 1 1 | 30 0.00 2 1.0 3 1.00 1 0 1 | 18 0.40 33 0.0 12 0.0 1 0 1
9 0.00 50 0.0 1 1.00 1 0 1 | 200 0.00 9 0.0 7 0.00 1 0 1 | 6 0.10 14 0.0 80 0.0 1 1 1 | 1 0.00 1 0.0 1 0.00 1 0 1
4 1.00 60 0.0 5 1.00 1 0 0 | 6 0.95 70 0.0 0 0.00 1 0 0 | 10 1.00 10 1.0 10 1.0 1 0 0 | 3 1.00 3 1.0 40 0.0 1 0 0
1 1.00 0 0.0 1 1.00 -1 0 0 | 4 0.00 1 1.0 60 0.00 -1 0 0 | 30 0.00 0 0.0 2 1.00 -1 0 0 | 80 0.00 60 0.0 40 0.0 -1 0 0
14 0.00 90 0.0 0 0.00 -1 0 0 | 55 0.05 30 0.0 9 0.00 -1 0 0 | 2 0.00 5 1.0 3 1.00 -1 1 0 | 7 0.50 7 0.5 7 0.50 -1 0 0
120 0.00 3 0.0 0 0.0 -1 0 0 | 9 0.00 12 0.0 200 0.0 -1 1 0 | 20 0.00 25 0.0 18 0.0 -1 0 0 | 3 0.00 0 0.0 0 0.00 -1 0 0
60 0.00 8 0.0 70 0.00 0 0 1 | 45 0.10 50 0.1 30 0.00 0 0 1 | 22 0.00 60 0.0 4 0.00 0 0 1 | 100 0.05 2 1.0 3 1.0 0 0 1
12 0.00 40 0.0 35 0.00 0 0 1 | 9 0.00 1 1.0 50 0.00 0 1 1 | 7 0.00 60 0.0 55 0.00 0 1 1 | 50 0.25 1 0.9 40 0.0 0 0 1
18 0.00 22 0.0 21 0.00 0 0 1 | 14 0.10 80 0.0 20 0.10 0 0 1 | 45 0.00 4 1.0 2 1.00 0 0 1 | 6 0.00 45 0.0 70 0.0 0 0 1
30 0.00 0 0.0 0 0.00 0 0 1 | 19 0.00 3 0.0 25 0.00 0 0 1 | 24 0.20 16 0.0 18 0.00 0 0 1 | 70 0.00 0 0.0 0 0.0 0 0 1
1 1.00 1 1.0 1 1.00 0 0 0 | 3 0.00 1 1.0 2 1.00 0 0 0 | 8 0.80 6 1.0 7 0.90 0 0 0 | 4 0.00 3 0.0 2 0.00 0 0 0
20 0.70 30 0.0 25 0.10 0 0 0 | 40 0.90 10 1.0 12 1.0 0 0 0 | 10 0.00 4 1.0 3 1.00 0 0 0 | 5 0.00 2 0.0 3 1.00 0 0 0
15 0.20 5 1.0 6 1.00 0 0 0 | 2 0.00 0 0.0 1 1.00 0 0 0 | 6 0.00 4 0.0 0 0.00 0 0 0 | 9 0.50 40 0.0 3 1.00 0 0 0
3 0.00 2 1.0 4 1.00 0 1 0 | 2 0.00 1 0.0 2 0.50 0 1 0 | 30 0.60 3 1.0 50 0.00 0 0 0 | 7 0.00 3 1.0 5 0.00 0 0 0
"""

#: Elements whose text never shows, that cut blocks, that hold others and may tell what they hold.
HIDDEN = frozenset("script style noscript template title textarea select button svg math iframe object head".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDS = frozenset("article aside blockquote body center dd details dialog div dl fieldset figure footer form header li main menu nav ol section span table td ul".split())
CLUTTER_TAGS = frozenset("aside dialog fieldset footer form menu nav".split())
#: Words in class, id or role that tell clutter, or the article.
CLUTTER = frozenset("ad ads advert advertisement advertising adsense alert author-box banner breadcrumb breadcrumbs byline-links comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer form gdpr hidden legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets".split())
ARTICLE = frozenset("article articlebody content main post entry story".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


def telling(tag: str, attributes: str, inside: int) -> int:
    """What an element says of its content: 1 article, -1 clutter, else as its parent (``inside``)."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return -1
    if tag in ("body", "html"):
        return inside
    words = {w for k in ("class", "id", "role", "itemprop") for w in _WORDS.findall(found.get(k, ""))}
    if tag in CLUTTER_TAGS or tag != "main" and words & CLUTTER and not (tag == "article" and not words & {"comment", "comments", "reply", "ad", "sponsored", "teaser", "related"}):
        return -1
    if tag == "header":
        return inside or -1
    if tag in ("article", "main") or words & ARTICLE:
        return inside or 1
    return inside


def blocks(html: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link share, context, heading) of every block with words, in page order."""
    out: list[tuple] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []
    context = heading = link = at = 0

    def flush() -> None:
        if text:
            words = "".join(text).split()
            if words:
                out.append((" ".join(words), len(words), min(1.0, len(" ".join(linked).split()) / len(words)), context, heading))
            text.clear()
            linked.clear()

    def add(part: str) -> None:
        if part:
            part = unescape(part)
            text.append(part)
            if link:
                linked.append(part)

    low = None
    while (m := _TOKEN.search(html, at)) is not None:
        add(html[at: m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in HIDDEN:
            if not closing and not attributes.endswith("/"):
                if low is None:
                    low = html.lower() if len(html.lower()) == len(html) else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
                if tag == "head":  # ends where the body begins, if its own end is missing
                    ends = [e for e in (low.find("</head", at), low.find("<body", at)) if e >= 0]
                    end = min(ends) if ends else at
                else:
                    end = low.find(f"</{tag}", at)
                at = end if end >= 0 else len(html)
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            link = int(not closing)
        if tag in BLOCK:
            flush()
            heading = int(not closing and tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
        if tag in HOLDS:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if tag != "span" or stack[i][1] != context:
                            flush()
                        context = stack[i][1]
                        del stack[i:]
                        link = 0 if tag != "span" else link
                        break
            elif not attributes.endswith("/"):
                new = telling(tag, attributes, context)
                if new != context:
                    flush()
                stack.append((tag, context))
                context = new
    add(html[at:])
    flush()
    return out


def _features(found: list[tuple]) -> list[list[float]]:
    edge = (0, 0.0)
    near = [edge, *((float(b[1]), float(b[2])) for b in found), edge]
    return [[*near[i + 1], *near[i], *near[i + 2], float(b[3]), float(b[4])] for i, b in enumerate(found)]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        found = [blocks(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([[b[0] for b in f] for f in found], pa.list_(pa.string())),
                                          pa.array([_features(f) for f in found], pa.list_(pa.list_(pa.float64())))], ["page_id", "url", "blocks", "features"])


def trained(spark: SparkSession, labelled: str = LABELLED):
    """The decision tree of the labelled table."""
    rows = [[float(x) for x in r.split()] for line in labelled.strip().splitlines() for r in line.split("|")]
    table = spark.createDataFrame([(r[:-1], r[-1]) for r in rows], "features array<double>, label double")
    return DecisionTreeClassifier(maxDepth=8, maxBins=64, seed=1).fit(table.withColumn("features", array_to_vector("features")))


def keeps(node, features: Column) -> Column:
    """The tree as nested conditions over an array of features."""
    if node.numDescendants() == 0:
        return F.lit(node.prediction() > 0.5)
    split = node.split()
    return F.when(features[split.featureIndex()] <= split.threshold(), keeps(node.leftChild(), features)).otherwise(keeps(node.rightChild(), features))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text (main blocks in page order, joined by one space), a row for each row.

    Null and empty html gives an empty text; repeated rows and null ids pass as they are; extra columns
    are ignored.  Character references are decoded; white space inside a block is one space.
    """
    root = trained(pages.sparkSession)._java_obj.rootNode()
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    cut = rows.mapInArrow(_pages, "page_id long, url string, blocks array<string>, features array<array<double>>")
    kept = F.filter("blocks", lambda b, i: keeps(root, F.col("features")[i]))
    return cut.select("page_id", "url", F.concat_ws(" ", kept).alias("text"))
