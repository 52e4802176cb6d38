"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, the more the
likelier their element holds main text; tags score negative, the more the
rarer they are within main text. One linear scan finds the contiguous region
of the highest sum. The weights come from labelled pages: those whose own
markup names the main text (article, main, role=main) and so tells which words
and tags lie in it. Counts of a bounded sample of them are summed by Spark;
scoring is per page within a task and shuffles nothing.
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

#: Labelled pages to learn from, at most about this many.
SAMPLE_PAGES = 4000

# Elements of HTML by their role.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "select", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PLAIN = INLINE - {"a", "label"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "search"}
BOILERPLATE_NAMES = {
    "alert", "alerts", "commentarea", "commentform", "commentlist", "commentthread", "discussion", "discussions", "responses",
    "ad", "ads", "adsense", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "footer", "header",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "share", "sharing", "side", "sidebar",
    "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "toolbar", "widget",
}
#: A class or id that begins or ends so tells what the page has, as in has-sidebar or share-enabled, not what the element is.
LAYOUT_FIRST, LAYOUT_LAST = {"has", "no", "with", "without"}, {"enabled", "disabled"}
#: In a name of several words the last one tells what the element is, unless only such words follow, as in related-posts.
HOLDERS = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "feed", "form", "group", "holder", "icon", "icons", "image", "inner", "item", "items",
    "danger", "info", "danger", "info", "left", "link", "links", "list", "main", "message", "news", "outer", "overlay", "panel", "posts", "right", "row", "section", "signup", "slot", "stories", "success", "text", "thread", "threads", "title", "toggle", "top", "unit", "warning", "widget", "wrap", "wrapper",
}
#: The header of one of these is its title, where it stands in marked main text.
OWN_HEADER = {"article", "chapter", "content", "entry", "page", "post", "section", "story"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Boilerplate names give way where the words under them outnumber the others by more than this.
OUTWEIGHS = 20
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
#: Elements that an opening tag of these closes when still open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure", "details", "menu"}
# Weights of elements before anything is learned, as if seen this often within and outside main text.
PRIOR_IN = {"p": 8, "article": 8, "main": 8, "blockquote": 6, "pre": 6, "h1": 6, "h2": 6, "h3": 6, "h4": 6, "h5": 4, "h6": 4, "section": 4, "figcaption": 4, "td": 3, "th": 3, "tr": 3, "table": 3, "dd": 4, "dt": 4, "div": 3, "li": 3, "ul": 3, "ol": 3, "br": 8, "body": 2, "html": 1}

# A quote holds a value only after an equals sign; what is not closed ends with the page. Nothing is tried twice, so a page is read in one pass.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?>=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
_NAME = re.compile(r"[a-z]+")
#: What a page itself says isn't shown: the attribute of that name outside quotes, and two styles.
_HIDDEN = re.compile(r"""(?:^|[\s"'/])hidden(?=$|[\s=/>])""", re.I)
_QUOTED = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+')""")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: What a page itself says isn't shown: the attribute of that name outside quotes, and two styles.
_HIDDEN = re.compile(r"""(?:^|[\s"'/])hidden(?=$|[\s=/>])""", re.I)
_QUOTED = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+')""")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Node:
    """An open element: its key for weights, whether it is boilerplate by element or role, and how many boilerplate names it is under."""

    __slots__ = ("name", "key", "hard", "cuts", "main")

    def __init__(self, name: str, key: str, hard: bool, cuts: int, main: bool):
        self.name, self.key, self.hard, self.cuts, self.main = name, key, hard, cuts, main


def _names(value: str) -> list[list[str]]:
    """The words of each class or id in an attribute, without layout names."""
    out = []
    for one in _CAMEL.sub("-", value).lower().split():
        words = _NAME.findall(one)
        if words and not (len(words) > 1 and (words[0] in LAYOUT_FIRST or words[-1] in LAYOUT_LAST)):
            out.append(words)
    return out


def _is_boilerplate(words: list[str], in_main: bool) -> bool:
    """Whether a name tells of boilerplate: by its last word, or by one that only holders follow."""
    for i in range(len(words) - 1, -1, -1):
        if words[i] in BOILERPLATE_NAMES:
            return not (in_main and words[i] == "header" and i and words[i - 1] in OWN_HEADER)
        if words[i] not in HOLDERS:
            return False
    return False


def _opened(name: str, rest: str, parent: Node) -> Node:
    key, hard, named, main = name, parent.hard or name in BOILERPLATE, False, name in ("article", "main")
    if "hidden" in rest.lower() and _HIDDEN.search(_QUOTED.sub("= ", rest)):
        hard = True
    if "hidden" in rest.lower() and _HIDDEN.search(_QUOTED.sub("= ", rest)):
        hard = True
    if rest and "=" in rest:
        for m in _ATTR.finditer(rest):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "role":
                hard, main = hard or value.lower() in ROLES, main or value.lower() == "main"
            elif kind == "style":
                hard = hard or _UNSHOWN.search(value) is not None
            elif kind == "style":
                hard = hard or _UNSHOWN.search(value) is not None
            elif kind in ("class", "id"):
                names = _names(value)
                if name == "section":  # a chapter of a paper
                    names = [words for words in names if words != ["discussion"]]
                if name == "section":  # a chapter of a paper
                    names = [words for words in names if words != ["discussion"]]
                if kind == "class" and names and key == name:
                    key = f"{name}.{'-'.join([w for words in names for w in words][:2])}"
                # a heading's id is made from its words, and what a page calls its heading is still a heading
                if name not in ("html", "body", "main") and name not in HEADINGS:
                    named = named or any(_is_boilerplate(words, parent.main) for words in names)
    if name == "header" and not parent.main:
        hard = True
    return Node(name, key, hard, parent.cuts + named, (main and not hard and not named) or parent.main)


def tokens(page: str) -> Iterator[tuple]:
    """The page in order: ("text", text, node) and ("tag", name, key, node, own); raw elements have no text.

    ``own`` is the element that a tag belongs to, ``node`` the one that is open after it.
    """
    root = Node("", "body", False, 0, False)
    stack, at, is_open = [root], 0, Counter()
    blocks = [0]  # where the last element that isn't inline stands, for each element on the stack

    def close(depth: int) -> None:
        for node in stack[depth:]:
            is_open[node.name] -= 1
        del stack[depth:], blocks[depth:]

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            yield "text", text, stack[-1]
        if not m:
            return
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if is_open[name] > 0:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                node = stack[depth]
                close(depth)
                yield "tag", name, node.key, stack[-1], node
            else:
                yield "tag", name, name, stack[-1], stack[-1]
            continue
        if name in VOID or m["rest"].endswith("/"):
            yield "tag", name, name, stack[-1], stack[-1]
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            yield "tag", name, name, stack[-1], stack[-1]
            continue
        # an open p, or item of the same list, ends here, with the inline elements that are still open in it
        shut, depth = CLOSES.get(name, ()), blocks[-1]
        if depth and (stack[depth].name in shut or name in CLOSES_P and stack[depth].name == "p"):
            close(depth)
        node = _opened(name, m["rest"], stack[-1])
        blocks.append(blocks[-1] if name in INLINE else len(stack))
        stack.append(node)
        is_open[name] += 1
        yield "tag", name, node.key, node, node


class LeftOut:
    """Which nodes of a page are left out: boilerplate by element or role, and what is under boilerplate names.

    A name is evidence only. If nearly all of the page's marked main text (of
    all its text, where none is marked) is under names, as in a wrapper called
    after its sidebar, so many names as most of it is under don't count.
    """

    def __init__(self, items: list[tuple]):
        at: Counter = Counter()
        self.labelled = any(t[3].main for t in items if t[0] == "tag")
        for t in items:
            if t[0] == "text" and not t[2].hard and (t[2].main or not self.labelled):
                at[t[2].cuts] += len(t[1].split())
        self.level, words, total = 0, at[0], sum(at.values())
        while OUTWEIGHS * words < total:
            self.level += 1
            words += at[self.level]

    def __call__(self, node: Node) -> bool:
        return node.hard or node.cuts > (self.level if node.main or not self.labelled else 0)


def page_counts(page: str) -> Counter:
    """How often each word context and each tag lies within ("w in", "t in") and outside main text; empty if the page isn't labelled."""
    found: Counter = Counter()
    items, block = list(tokens(page)), "body"
    out = LeftOut(items)
    if not out.labelled:
        return found
    for token in items:
        if token[0] == "text":
            node = token[2]
            block = node.key if node.name not in PLAIN else block
            if n := len(token[1].split()):
                found["w", block, node.main and not out(node)] += n
        else:
            node = token[3]
            block = node.key if node.name not in PLAIN else block
            if token[1] not in PLAIN:
                found["t", token[2], node.main and not out(node)] += 1
    return found


def _prior(key: str) -> tuple[float, float]:
    name, _, words = key.partition(".")
    if name in BOILERPLATE or name in RAW or name == "header" or name not in HEADINGS and _is_boilerplate(words.split("-"), True):
        return 0.2, 8.0
    return float(PRIOR_IN.get(name, 1)), 2.0 if name in ("p", "article", "main", "br") else 3.0


class Weights:
    """Scores of words by their element and of tags, from counts within and outside main text."""

    def __init__(self, counts: dict[tuple[str, str], tuple[int, int]]):
        self.counts = counts
        self.known: dict[tuple[str, str], float] = {}

    def share(self, kind: str, key: str) -> float:
        inside, outside = self.counts.get((kind, key), (0, 0))
        # what is learned counts for 50 sights at most next to the prior's 10, so that rare uses stay possible
        scale = min(1.0, 50 / max(1, inside + outside))
        a, b = _prior(key)
        return (inside * scale + a) / ((inside + outside) * scale + a + b)

    def word(self, key: str) -> float:
        if ("w", key) not in self.known:
            share = self.share("w", key)
            self.known["w", key] = max(0.3 if PRIOR_IN.get(key, 0) >= 3 else 0.02, min(1.0, (share - 0.3) / 0.4))
        return self.known["w", key]

    def tag(self, key: str) -> float:
        if ("t", key) not in self.known:
            # a list or table may stand in any article, whatever the labelled pages had it for
            most = 0.5 if PRIOR_IN.get(key, 0) >= 3 else 3.0
            self.known["t", key] = -max(0.02, min(most, -math.log(min(1.0, 1.15 * self.share("t", key)))))
        return self.known["t", key]


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the best region: blocks in order, joined by single spaces; "" if there is none.

    The scan is Kadane's: the sum starts anew where it would fall below zero;
    of equal regions the first, and of those the longest start, wins. Within
    the region, elements that are boilerplate by name or role are left out.
    """
    if not page:
        return ""
    items, block = list(tokens(page)), "body"
    out = LeftOut(items)
    best, best_span, run, begin = 0.0, None, 0.0, 0
    for i, token in enumerate(items):
        if token[0] == "text":
            node = token[2]
            block = node.key if node.name not in PLAIN else block
            n = len(token[1].split())
            score = n * (0.02 if out(node) else weights.word(block)) if n else 0.0
        else:
            node = token[3]
            block = node.key if node.name not in PLAIN else block
            score = 0.0 if token[1] in PLAIN else weights.tag(token[2])
            # what the markup itself calls main text is not broken by a tag in it
            score = max(score, -0.5) if node.main else score
            # nor is any text by what is left out between, however long; an end tag still counts outside main text
            if out(node) or node.main and out(token[4]):
                score = 0.0
        if run <= 0:
            run, begin = 0.0, i
        run += score
        if run > best:
            best, best_span = run, (begin, i + 1)
    if best_span is None:
        return ""
    parts = []
    for token in items[best_span[0] : best_span[1]]:
        if token[0] == "tag":
            if token[1] not in INLINE:
                parts.append(" ")
        elif not out(token[2]):
            parts.append(html.unescape(token[1]))
        else:
            parts.append(" ")
    return " ".join("".join(parts).split())


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from about ``sample`` pages, chosen by a hash of the id (all, if there are fewer).

    Pages without labels add nothing; without any labelled page the prior
    weights stand. The model has the elements and classes of the sample, so it
    is bounded by the sample too.
    """
    total = pages.select(id_col).count()
    unit = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(77)), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if page:
                    found.update(page_counts(page))
        if found:
            kinds, keys, inside = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(inside), pa.array(found.values(), pa.int64())], names=["kind", "key", "inside", "n"])

    rows = (
        pages.where(unit < min(1.0, sample / max(1, total)))
        .select(F.col(html_col).cast("string"))
        .mapInArrow(count, "kind string, key string, inside boolean, n long")
        .groupBy("kind", "key")
        .agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
        .collect()
    )
    return Weights({(r["kind"], r["key"]): (r["a"], r["b"]) for r in rows})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty html give empty text, as does a page without words.
    Character references are decoded, white space within a block becomes one
    space, blocks are joined by one space in page order. Repeated rows stay;
    null ids and urls pass through; further columns are not read; an empty
    table gives an empty result.
    """
    weights = weights or learn_weights(pages, id_col, html_col)
    counts = weights.counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(counts)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                texts = [main_text(page, own) for page in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
