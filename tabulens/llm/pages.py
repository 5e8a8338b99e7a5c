"""Main text of HTML pages: the contiguous region with the highest score.

A page is read as a sequence of tags and words. Words score positive and tags
negative; one linear scan finds the stretch with the greatest sum. The weights
are log odds from labelled pages: those that mark their content with `article`
or `main`, where a word or tag inside is content and anything else is not. They
are counted per context, which every page has, marked or not: the innermost
block, whether most of its words are links, and the first class or id around it.
Names that few labelled pages have are left out of the context, and contexts
that the sample does not have keep the prior weights, by which blocks of links
are not content. A page that marks its content needs no weights: what it marks is
content, and anything else is not. Boilerplate by its tag is never content. Of
several marks the largest one counts, and those beside it that neither have a
listed name (a reader's comment) nor consist of links (a teaser).

A class, id or role tells only what a part of the page is. It is ignored on
elements that hold most of the page's words, on those around the largest
`article` and `main`, and on the whole page where nothing else would be left.

Inside the region, blocks with a negative weight (an advert in the middle of an
article) are left out; boilerplate there costs almost nothing, so it never cuts
a region in two.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.shared import bounded_batches

#: Labelled pages that the weights are fitted on, chosen by a hash of the page.
SAMPLE_PAGES = 1000
PRIOR = 20
WORD, BRIDGE, TAG, OUTSIDE, LINKS = 1.0, -0.001, -0.02, -4.0, -0.5

#: Elements whose content is never text.
RAW = frozenset("script style noscript template iframe svg math object canvas select textarea title xmp".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog button head".split())
CONTENT = frozenset("article main".split())
#: Of these, elements that `/>` closes, and those that hold the rest of the page if nothing ends them: it is code.
CLOSABLE = frozenset("svg math object".split())
CODE = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody "
    "tfoot thead tr ul".split()
)
#: Words in class, id or role that say what an element is.
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead footer sidebar aside "
    "complementary contentinfo widget widgets related recommended share sharing social cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login search form comment "
    "comments commentlist respond replies disqus discussion hidden".split()
)

#: A class or id of exactly this is a discussion, however long.
DISCUSSION = frozenset("comments comment-list commentlist respond replies disqus disqus_thread discussion".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_LOOSE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z0-9]+")
_CALLED = re.compile(r"[a-z][a-z_-]{0,31}")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)")


class Element:
    """An element of the page: what it is in, and what it says it is."""

    __slots__ = ("parent", "tag", "fixed", "name", "long", "called", "linked", "words", "links", "listed", "content")

    def __init__(self, parent: int, tag: str, more: str):
        self.parent, self.tag, self.words, self.links = parent, tag, 0, 0
        self.fixed = tag in BOILERPLATE
        self.linked, self.called = tag == "a", ""
        self.name, self.long = ("form", False) if tag == "form" else ("", False)
        if "=" in more and tag not in ("html", "body"):
            for found in _NAMED.finditer(more):
                value = next(filter(None, found.groups()), "")
                if tag not in CONTENT:
                    self.called = self.called or "".join(_CALLED.findall(value.lower())[:1])
                split = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
                self.name = self.name or next(filter(NAMES.__contains__, _PART.findall(split)), "")
                self.long = self.long or not DISCUSSION.isdisjoint(value.lower().split())
        if "hidden" in more and tag not in ("html", "body") and tag not in CONTENT:
            self.fixed = self.fixed or bool(_HIDDEN.search(_QUOTED.sub("", more)))


def tokens(html: str) -> tuple[list[tuple[str, str, int]], list[Element]]:
    """(kind, value, number of the element it is in) of all tokens, and the elements, each after its parent.

    Kinds: `text` (value is the text as written) and `tag` (value is the tag's
    name, with a slash for ends).
    """
    found: list[tuple[str, str, int]] = []
    elements = [Element(0, "", "")]
    stack: list[tuple[str, int]] = []
    open_tags: Counter = Counter()
    here = 0
    endless: set[str] = set()
    at = 0
    while token := _TOKEN.search(html, at):
        start = token.start()
        if start > at:
            found.append(("text", html[at:start], here))
        at = token.end()
        tag, end, more = token["tag"], token["end"], token["more"] or ""
        if tag is None:
            if html.startswith(("<!", "<?"), start):
                continue
            loose = _LOOSE.match(html, start)
            if not loose:
                continue
            tag, end = loose["tag"], loose["end"]
        tag = tag.lower()
        if tag in RAW and not end:
            if tag in CLOSABLE and html.startswith("/>", at - 2) or tag in endless:
                continue
            close = _RAW_END[tag].search(html, at)
            if close:
                at = close.end()
            elif tag in CODE:
                at = len(html)
            else:
                endless.add(tag)  # only the tag itself is skipped, here and from here on
            continue
        if end:
            if open_tags[tag]:
                while True:
                    last, here = stack.pop()
                    open_tags[last] -= 1
                    if last == tag:
                        break
        else:
            if tag in BLOCK and tag != "br" and open_tags["p"] and stack[-1][0] in ("p", "b", "i", "em", "strong", "a", "span"):
                # A block ends an open paragraph and what was left open in it.
                while open_tags["p"]:
                    last, here = stack.pop()
                    open_tags[last] -= 1
                    if last == "p":
                        break
            if tag == "li" and stack and stack[-1][0] == "li":
                last, here = stack.pop()
                open_tags[last] -= 1
            if tag not in VOID and not more.endswith("/"):
                stack.append((tag, here))
                open_tags[tag] += 1
                elements.append(Element(here, tag, more))
                here = len(elements) - 1
        found.append(("tag", ("/" if end else "") + tag, here))
    if at < len(html):
        found.append(("text", html[at:], here))
    return found, elements


def settle(elements: list[Element]) -> None:
    """Sets `words` to those of the whole element, and the rest by what is around it."""
    for element in elements[1:]:
        outer = elements[element.parent]
        element.fixed = element.fixed or outer.fixed
        element.linked = element.linked or outer.linked
        element.called = element.called or outer.called
        element.links = element.words * element.linked
    for element in reversed(elements[1:]):
        if not element.fixed:
            elements[element.parent].words += element.words
            elements[element.parent].links += element.links
    ignored = set()
    for tag in CONTENT:
        marks = (i for i, e in enumerate(elements) if e.tag == tag and not e.fixed)
        i = max(marks, key=lambda m: elements[m].words, default=0)
        while i:
            ignored.add(i)
            i = elements[i].parent
    most = elements[0].words / 2
    elements[0].listed, elements[0].content = "", False
    for i, element in enumerate(elements[1:], 1):
        outer = elements[element.parent]
        own = "" if i in ignored or element.words > most and not element.long else element.name
        if not own and element.tag in CONTENT and i not in ignored and 2 * element.links > element.words:
            own = "related"
        element.listed = outer.listed or own
        element.content = outer.content or (element.tag in CONTENT and not element.fixed and not element.listed)


def features(html: str) -> list[tuple[str, str, str, bool | None, int, str]]:
    """(kind, context, name, inside, words, text) of the page's tokens.

    The context is that of a page without marks, ending in `!` in boilerplate by
    tag and in `~` and a name in what is listed. `name` is the first class or id
    around the token, and `inside` tells whether the page marks it as content;
    it is null if the page marks nothing.
    """
    found, elements = tokens(html)
    texts = [unescape(value) if kind == "text" and "&" in value else value for kind, value, _ in found]
    sizes = [len(text.split()) if kind == "text" else 0 for (kind, _, _), text in zip(found, texts)]
    for (_, _, i), size in zip(found, sizes):
        elements[i].words += size
    settle(elements)
    has_marks = any(kind == "text" and elements[i].content and not elements[i].fixed for kind, _, i in found)
    # Words and linked words of each stretch between two ends of blocks.
    stretches, number = [[0, 0]], []
    for (kind, value, i), size in zip(found, sizes):
        if kind == "tag" and value.lstrip("/") in BLOCK:
            stretches.append([0, 0])
        number.append(len(stretches) - 1)
        stretches[-1][0] += size
        stretches[-1][1] += size * elements[i].linked
    block, rows = "body", []
    for (kind, value, i), text, size, part in zip(found, texts, sizes, number):
        at = elements[i]
        where = "!" if at.fixed else f"~{at.listed}" if at.listed else ""
        inside = at.content if has_marks else None
        if kind == "text":
            words, linked = stretches[part]
            links = "/links" if 2 * linked > words else ""
            rows.append(("word", f"word:{block}{links}{where}", at.called, inside, size, text))
        else:
            name = value.lstrip("/")
            if name in BLOCK:
                block = "body" if value.startswith("/") or name == "br" else name
                rows.append(("block", f"tag:{name}{where}", "", inside, 0, ""))
            else:
                rows.append(("tag", f"tag:{name}{where}", "", inside, 0, " " if name in ("td", "th") else ""))
    return rows


def prior(key: str) -> float:
    """The weight of a context that no labelled page has."""
    return LINKS if "/links" in key and not key.startswith("word:h1/") and marked(key) == WORD else marked(key)


def marked(key: str) -> float:
    """The weight of a context in what a page marks as content."""
    if key.endswith("!") or "~" in key:
        return BRIDGE
    return TAG if key.startswith("tag:") else WORD


def weigh(key: str, inside: int, outside: int) -> float:
    """Log odds with the prior as some observations; words between -1 and 1, tags and boilerplate by tag never positive."""
    if not inside + outside or key.endswith("!"):
        return prior(key)
    if "~" in key:
        # Listed names start from even odds: as many observations either way.
        odds = math.log((inside + PRIOR) / (outside + PRIOR))
        return min(BRIDGE, max(odds, -WORD)) if key.startswith("tag:") else min(WORD, max(odds, -WORD))
    odds = math.log((inside + PRIOR) / (outside + 1))
    if key.startswith("tag:"):
        return min(TAG, max(odds, -WORD))
    return min(WORD, max(odds, -WORD))


def weight_of(key: str, name: str, inside: bool | None, weights: dict[str, float]) -> float:
    """The weight of a token: by the page's own marks if it has any, else as learned, with the name if that is known."""
    if inside is None:
        return weights.get(f"{key}.{name}", weights.get(key, prior(key)))
    return marked(key) if inside or not key.startswith("word:") or marked(key) == BRIDGE else OUTSIDE


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the stretch with the greatest positive sum; (0, 0) if there is none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(html: str, weights: dict[str, float]) -> str:
    rows = features(html)

    def scored(listed: bool) -> tuple[tuple[int, int], list[float]]:
        known: dict[tuple, float] = {}
        each = []
        for _, key, name, inside, _, _ in rows:
            if (key, name, inside) not in known:
                known[key, name, inside] = weight_of(key if listed else key.split("~")[0], name, inside, weights)
            each.append(known[key, name, inside])
        return best_region([w * row[4] if row[0] == "word" else w for w, row in zip(each, rows)]), each

    region, weight = scored(True)
    if region == (0, 0):
        # A page that is all of one listed name is what the name says.
        region, weight = scored(False)
    start, end = region
    blocks: list[list[str]] = [[]]
    for (kind, _, _, _, _, text), own in zip(rows[start:end], weight[start:end]):
        if kind == "block":
            blocks.append([])
        elif kind == "tag" or own > 0:
            blocks[-1].append(text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def fit_weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most `sample` labelled pages, those with the smallest hash of id and address.

    Repeated rows of a page are fitted once. Only that many hashes and one row
    per context come to the driver, of contexts with `PRIOR` words or tags at least.
    """
    labelled = pages.filter(F.lower(F.col("html")).rlike("<(article|main)[ >]"))
    chance = F.xxhash64("page_id", "url")
    bound = labelled.select(chance.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if bound is None:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                for kind, key, name, inside, words, _ in features(html):
                    if inside is None or key.endswith("!"):
                        continue
                    counts[key, inside] += words if kind == "word" else 1
                    if name:
                        counts[f"{key}.{name}", inside] += words
        keys, inside = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(inside, pa.bool_()), pa.array(list(counts.values()), pa.int64())],
            ["key", "inside", "n"],
        )

    chosen = labelled.filter(chance <= bound).select("page_id", "url", "html").dropDuplicates(["page_id", "url"])
    counted = chosen.select("html").mapInArrow(count, "key string, inside boolean, n long")
    inside, outside = (F.sum(F.when(F.col("inside") == v, F.col("n")).otherwise(0)) for v in (True, False))
    rows = counted.groupBy("key").agg(inside.alias("i"), outside.alias("o")).filter(F.col("i") + F.col("o") >= PRIOR)
    return {r["key"]: weigh(r["key"], r["i"], r["o"]) for r in rows.collect()}


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url and the main text of every page.

    Null, empty and tag-free pages are handled like any other: null html gives
    an empty text, plain words are content. Repeated rows give equal texts. Very
    long pages are read whole, as one string in one task. An empty table stays
    empty. Other columns do not matter.
    """
    bounded_batches(pages)
    weights = fit_weights(pages) if weights is None else weights

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html or "", weights) for html in batch.column("html").to_pylist()]
            yield batch.drop_columns(["html"]).append_column("text", pa.array(texts, pa.string()))

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    return pages.select("page_id", "url", "html").mapInArrow(extract, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))


# The pages of the test tables mark their content; the rules for anything else are tested on fixtures.
ORACLE = r"""
    WITH bodies AS (
        SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|<footer>)', 1) AS body FROM pages),
    blocks AS (
        SELECT page_id, url, list_filter(list_transform(
            string_split(regexp_replace(body, '</?(p|br|h1)>', chr(10), 'g'), chr(10)),
            lambda b: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'),
                '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s]+', ' ', 'g'))), lambda b: b <> '') AS bs
        FROM bodies)
    SELECT page_id, url, regexp_replace(array_to_string(bs, chr(10)), '&amp(\n|$)', '&\1', 'g') AS text,
           length(regexp_replace(array_to_string(bs, chr(10)), '&amp(\n|$)', '&\1', 'g')) AS n_chars
    FROM blocks"""
