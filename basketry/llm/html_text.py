"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive and tags negative, each with a
weight learnt from labelled pages, those with one ``article`` element: how much more often a
word of such a block, or such a tag, stands inside the article than outside. One linear scan
finds the contiguous run of tokens with the largest sum; all its blocks are the text, without
the furniture among them.

Names teach what furniture is: every word that classes, ids and roles end in has a weight,
learnt from the words in elements of that name outside and inside of articles. A list of
names (``FURNITURE_NAMES``) is where learning starts from, so that names that no labelled page
has are judged too. An element whose names weigh little is furniture unless it turns out to
wrap the page's content (``wrappers``). Some elements are furniture by what HTML says that they
are (``FURNITURE``, hidden ones).
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, pieces

#: Labelled pages learnt from, on average; of their tags and names the most frequent are kept, others have the weight they start from.
LEARN_PAGES, LEARNT = 2_000, 50_000
#: Weight of an unknown tag, the least of any tag, and the largest weight of a word either way.
TAG_WEIGHT, TAG_LEAST, MOST = -0.1, -1.0, 3.0
#: Weight of a word in furniture, and the most that an element of it costs with all its tags. Inside main or
#: article it costs nothing: an advert within an article doesn't end it.
OUT_WEIGHT, OUT_MOST = -0.5, -30.0
#: Weight of a word beside an article or main element that has most words of the page, unless it is in a heading; and the least inside.
BESIDE, INSIDE = -0.5, 0.5
#: Where learning starts for a listed name, the most that it moves a name's weight, and the weight from which an element is furniture.
LISTED, MOVES, FURNITURE_FROM = -3.0, 4.0, -1.0
#: An element inside the article teaches its names only with so large a share of the article's words: an advert in it doesn't make adverts content.
WRAPS = 1 / 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# The elements of HTML by what they mean here.
#: Their text is no text.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title".split())
_RAW_END = {name: re.compile(f"</{name}(?![A-Za-z0-9:-])", re.I | re.A) for name in RAW}
#: Never part of an article.
FURNITURE = frozenset("nav footer aside button dialog menu head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: They begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open one ends when the same or another of these begins.
CLOSED_BY_SAME = {"p": BLOCKS - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
#: Names from which furniture is expected until pages teach otherwise.
FURNITURE_NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo "
    "cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words behind the one that a name is about, and words in front that tell of an element elsewhere.
CONTAINERS = frozenset(
    "area articles bar block bottom box button buttons column container content form group inner item items left link links list module outer panel posts right row section slot stories top unit wrap wrapper".split()
)
ELSEWHERE = frozenset("has hide is no non not off with without".split())
#: A header inside an article may hold its title; outside it is furniture.
SECTIONS = frozenset("article aside body div dialog fieldset figure footer form header main menu nav section table ul ol".split())


def name_of(token: str) -> str:
    """What a class, id or role is about: its last word but for ``CONTAINERS``; empty if it tells of an element elsewhere."""
    words = [w.lower() for w in _NAME.findall(token)]
    if not words or len(words) > 1 and words[0] in ELSEWHERE:
        return ""
    while len(words) > 1 and words[-1] in CONTAINERS:
        words.pop()
    return words[-1]


@dataclass(frozen=True)
class Weights:
    """Weights of words by their innermost block (``other`` for unknown ones), of tags, and of names."""

    by_context: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    names: dict[str, float] = field(default_factory=dict)

    def tag(self, name: str) -> float:
        return self.tags.get(name, TAG_WEIGHT)

    def is_furniture(self, names: set[str]) -> bool:
        """Whether names weigh so little that their element is furniture."""
        return any(self.names.get(n, LISTED if n in FURNITURE_NAMES else 0.0) <= FURNITURE_FROM for n in names)


UNTAUGHT = Weights()


@dataclass
class Element:
    """An open element: its name, innermost block and whether its text is out of the question."""

    name: str
    context: str
    out: bool
    in_article: bool
    in_main: bool
    piece: int  # number of the outermost furniture element around it, 0 for none
    hard: bool  # in furniture, whatever the named elements around it are
    hidden: bool
    named: int  # number of the innermost named element around it, 0 for none
    names: frozenset[str] = frozenset()
    words: int = 0  # in it, and those of them in the article
    article: int = 0


@dataclass
class Named:
    """A form or an element with a listed word; its words are those outside of other furniture."""

    outer: int  # the named element around it
    in_main: bool
    before: int  # words of main or article directly in the outer one before it
    holds_main: bool = False
    own: int = 0  # words directly in it, without headings
    own_article: int = 0  # those of main or article
    words: int = 0
    article: int = 0


def wrappers(named: list[Named]) -> frozenset[int]:
    """The named elements that aren't furniture; the first stands for the page itself.

    An element outside main and article wraps content if it holds ``main``; or has words of an
    article, with none beside it before it and fewer behind it; or if there is no article
    and nothing but headings beside named elements, of which it has most words. One inside
    main or article does if nothing but headings of those is beside it, and it has most words.
    """
    for n in named:
        n.words, n.article = n.words + n.own, n.article + n.own_article
    for n in reversed(named[1:]):  # an element comes behind the one around it
        outer = named[n.outer]
        outer.words, outer.article, outer.holds_main = outer.words + n.words, outer.article + n.article, outer.holds_main or n.holds_main
    most: dict[tuple[int, bool], int] = {}
    for i, n in enumerate(named[1:], 1):
        at = (n.outer, n.in_main)
        if at not in most or n.words > named[most[at]].words:
            most[at] = i
    wraps = {0}
    for i, n in enumerate(named[1:], 1):
        outer = named[n.outer]
        if n.outer not in wraps or not (n.words or n.holds_main):
            continue
        alone = most[n.outer, n.in_main] == i and not (outer.own_article if n.in_main else outer.own or outer.article)
        first = not n.in_main and (n.holds_main or n.article > outer.own_article and not n.before)
        if alone or first:
            wraps.add(i)
    return frozenset(wraps - {0})


@dataclass
class Page:
    """The tokens of a page: for each run of text its context, and where blocks begin.

    ``costs`` has the weight of the tags before each run. ``pieces`` has for each run the number of its
    furniture element, 0 for none, and -1 inside main or article; ``mains`` whether it stands in one of those.
    """

    runs: list[tuple[str, str, bool, bool, int]] = field(default_factory=list)  # text, context, out, labelled, block
    costs: list[float] = field(default_factory=list)
    pieces: list[int] = field(default_factory=list)
    mains: list[bool] = field(default_factory=list)


def tokenize(page: str, weights: Weights = UNTAUGHT, teach: Taught | None = None) -> Page:
    """Runs of text with their context; a second pass if named elements turn out to wrap content."""
    found, named = _scan(page, weights, frozenset(), None)
    wraps = wrappers(named)
    return _scan(page, weights, wraps, teach)[0] if wraps or teach else found


class Taught:
    """What pages teach: (kind, name) and how often inside and outside of the article."""

    def __init__(self):
        self.counts: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])

    def add(self, kind: str, name: str, inside: bool, n: int) -> None:
        self.counts[kind, name][not inside] += n


def _scan(page: str, weights: Weights, wraps: frozenset[int], teach: Taught | None) -> tuple[Page, list[Named]]:
    """One linear pass, whatever is left open or closed twice; named elements in ``wraps`` aren't furniture."""
    out, stack, at, block, cost = Page(), [Element("", "", False, False, False, 0, False, False, 0)], 0, 0, 0.0
    named = [Named(0, False, 0)]
    closed: list[Element] = []  # of the article's words, for what is taught
    skip_to = made = inner = 0  # inner: tags inside furniture since the last run

    def text(raw: str) -> None:
        nonlocal cost, inner
        if raw and not raw.isspace():
            top = stack[-1]
            out.runs.append((raw, top.context, top.out, top.in_article, block))
            out.costs.append(cost - inner if top.out else cost)
            out.pieces.append(top.piece)
            out.mains.append(top.in_main)
            cost = 0.0
            inner = 0
            if teach is not None or not top.hard:
                n = len(raw.split())
                top.words += n
                top.article += n if top.in_article else 0
                if not top.hard and top.context not in HEADINGS:
                    inmost = named[top.named]
                    inmost.own += n
                    inmost.own_article += n if top.in_main else 0
        elif raw and out.runs:
            last = out.runs[-1]
            if last[4] == block:
                out.runs[-1] = (last[0] + " ", *last[1:])

    def pay(name: str, out: bool) -> None:
        """A tag costs its weight, or counts for the furniture that it is in, begins or ends."""
        nonlocal cost, inner
        if out:
            inner += 1
        else:
            cost += weights.tag(name)
            if teach is not None:
                teach.add("tag", name, stack[-1].in_article, 1)

    def close(depth: int) -> None:
        if teach is not None:
            for e in range(len(stack) - 1, depth - 1, -1):
                stack[e - 1].words += stack[e].words
                stack[e - 1].article += stack[e].article
                if stack[e].names:
                    closed.append(stack[e])
        del stack[depth:]

    for m in _TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            pay(name, stack[-1].out)
            if name in BLOCKS:
                block += 1
            depth = len(stack) - 1
            while depth > 0 and stack[depth].name != name:
                # an inline end tag doesn't close blocks around it
                if name not in BLOCKS and stack[depth].name in SECTIONS:
                    depth = 0
                    break
                depth -= 1
            if depth > 0:
                close(depth)
            continue
        if name in BLOCKS:
            block += 1
            while len(stack) > 1 and name in CLOSED_BY_SAME.get(stack[-1].name, ()):
                close(len(stack) - 1)
            if name in BLOCKS and name not in SECTIONS:
                # a new block ends inline elements that were left open around an unclosed p
                depth = len(stack) - 1
                while depth > 0 and stack[depth].name not in BLOCKS:
                    depth -= 1
                if depth > 0 and stack[depth].name == "p" and name in CLOSED_BY_SAME["p"]:
                    close(depth)
        if name in EMPTY or name in RAW:
            pay(name, stack[-1].out)
        if name in EMPTY:
            continue
        attributes = m[3] or ""
        if name in RAW:
            if attributes.rstrip().endswith("/"):
                continue
            end = _RAW_END[name].search(page, at)
            close_at = page.find(">", end.end()) if end else -1
            at = skip_to = len(page) if close_at < 0 else close_at + 1
            continue
        names, hidden = set(), False
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role"):
                    names.update(map(name_of, value.split()))
                elif key == "style":
                    hidden |= "display:none" in value.lower().replace(" ", "")
                elif key == "hidden" or value.lower() == "true":
                    hidden = True
            names.discard("")
        top = stack[-1]
        article = top.in_article or name == "article"
        main = top.in_main or name in ("article", "main") or "main" in names
        hidden |= top.hidden
        # what main is left in by broken markup doesn't count
        hard = hidden or name in FURNITURE or top.hard and name != "main" or (name == "header" or names == {"header"}) and not top.in_main
        inmost = top.named
        if name == "form" or names and name not in ("html", "body", "article", "main") and weights.is_furniture(names):
            inmost = len(named)
            named.append(Named(top.named, top.in_main, named[top.named].own_article))
        elif name == "main" and not hidden:
            named[inmost].holds_main = True
        soft = inmost > 0 and (inmost not in wraps)
        furniture = hard or soft
        pay(name, furniture)
        context = name if name in BLOCKS else top.context
        piece = top.piece if furniture else 0
        if furniture and not top.out:
            made += 1
            piece = -1 if top.in_main else made
        stack.append(Element(name, context, furniture, article, main, piece, hard, hidden, inmost, frozenset(names)))
    if at < len(page):
        text(page[at:])
    if teach is not None:
        close(1)
        whole = stack[0].article
        for e in closed:
            if not e.article:
                for n in e.names:
                    teach.add("name", n, False, e.words)
            elif e.in_article and e.name != "article" and e.article >= WRAPS * whole:
                for n in e.names:
                    teach.add("name", n, True, e.article)
    return out, named


def learn(pages: DataFrame, learn_pages: int = LEARN_PAGES, learnt: int = LEARNT) -> Weights:
    """Weights from labelled pages, those with one article element, of which a share by hash is taken.

    Words and tags in furniture teach nothing about blocks and tags: those may well stand in articles.
    """
    labelled = columns(pages, "page_id", "html").where(F.regexp_count(F.lower("html"), F.lit(r"<article[\s>]")) == 1)
    n = labelled.count()
    share = min(1.0, learn_pages / n) if n else 0.0
    chance = F.pmod(F.xxhash64(F.lit("learn"), F.col("page_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = Taught()
            for page in batch.column("html").to_pylist():
                for raw, context, out, inside, _ in tokenize(page, UNTAUGHT, found).runs:
                    if not out:
                        found.add("word", context, inside, len(raw.split()))
            keys, counts = list(found.counts), list(found.counts.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)],
                ["kind", "name", "ins", "outs"],
            )

    rows = (
        labelled.where(chance < share)
        .mapInArrow(count, "kind string, name string, ins long, outs long")
        .groupBy("kind", "name")
        .agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"))
        .orderBy(F.desc(F.col("ins") + F.col("outs")), "kind", "name")
        .limit(learnt)
        .collect()
    )
    tables: dict[str, dict[str, float]] = {"word": {}, "tag": {}, "name": {}}
    for r in rows:
        odds = math.log((r["ins"] + 1) / (r["outs"] + 1))
        if r["kind"] == "word":
            weight = max(-MOST, min(MOST, odds))
        elif r["kind"] == "tag":
            weight = max(TAG_LEAST, min(TAG_WEIGHT, odds))
        else:
            weight = (LISTED if r["name"] in FURNITURE_NAMES else 0.0) + max(-MOVES, min(MOVES, odds))
        tables[r["kind"]][r["name"]] = weight
    return Weights(tables["word"], 1.0, tables["tag"], tables["name"])


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first contiguous run with the largest sum, as (start, end); (0, 0) if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, where = total, (start, i + 1)
    return where


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best run, one a line."""
    if not page:
        return ""
    found = tokenize(page, weights)
    sizes = [len(raw.split()) for raw, *_ in found.runs]
    inside = sum(n for n, run, main in zip(sizes, found.runs, found.mains, strict=True) if main and not run[2])
    marked = 2 * inside > sum(n for n, run in zip(sizes, found.runs, strict=True) if not run[2])
    start, end = best_run(_scores(found, sizes, weights, marked))
    if not end:  # no block of the kinds that articles have: all count alike
        start, end = best_run(_scores(found, sizes, UNTAUGHT, marked))
    blocks: dict[int, list[str]] = {}
    for raw, _, out, _, block in found.runs[start // 2 : -(-end // 2)]:
        if not out:
            blocks.setdefault(block, []).append(raw)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def _scores(found: Page, sizes: list[int], weights: Weights, marked: bool) -> list[float]:
    """The weight of the tags before each run, then that of its words; ``marked`` if main or article hold most of them."""
    scores, piece, left = [], 0, OUT_MOST  # a furniture element, and what more it may cost
    for (_, context, out, _, _), n, cost, at, main in zip(found.runs, sizes, found.costs, found.pieces, found.mains, strict=True):
        weight = OUT_WEIGHT if out else weights.by_context.get(context, weights.other)
        if marked and not out:
            if main:
                weight, cost = max(weight, INSIDE), max(cost, -weight * n / 2, -INSIDE * n / 2)
            elif context not in HEADINGS:
                weight = min(weight, BESIDE)
        costs = [cost, weight * n]
        if out:
            if at != piece:
                piece, left = at, OUT_MOST
            for i, c in enumerate(costs):
                costs[i] = 0.0 if at < 0 else max(c, left)
                left -= costs[i]
        scores += costs
    return scores


def extract(pages: DataFrame, weights: Weights | None = None, **options: int) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``.

    The whole page is read, however long, in time linear in its length. Null and empty pages, and
    pages without words, have an empty text; repeated rows give repeated results; null ids and urls
    are kept; other columns play no part; an empty table gives none. Without labelled pages every
    block counts alike and names have the weight that learning starts from. Learning runs when called.
    """
    held = pages.sparkSession.sparkContext.broadcast(weights or learn(pages, **options))  # bounded by LEARNT
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(page, held.value) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return columns(pages, "page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
