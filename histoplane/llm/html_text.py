"""Main text of web pages by composite text density.

A page becomes a tree (unclosed and stray tags as browsers treat them: void elements, implied ends of
``p``, ``li`` and the like, raw script and style). Elements whose tag, role or hidden state says that they are no article
(menus, headers, footers, forms, scripts) go first, and those that a telling class or id names as side matter (``sidebar``,
``comments``); but those around the least deep articles (or ``main``) stay where every article stands in some, and on a page
without articles those that hold more than half of its text. For every remaining node the characters per tag, adjusted for links,
give its density, and the sum of its children's densities its rank. Other names are evidence within that score: a weaker word in a
longer name (``related-work``, ``page-widget``) lowers the densities of the element and all inside by its share of the name, an
``article`` or ``main`` raises its own rank.

The subtree of largest rank is text; the smallest density on the path from it to the body is the threshold. Of other nodes that
reach it, the largest-ranked subtrees are text too (beside an ``article`` or ``main`` only its sibling articles). Inside, an element
with a weaker name goes if its lowered density doesn't reach half the threshold.

White space, also after decoding references, becomes one space; block elements and ``br`` part words,
inline elements don't. A null or empty page, or one without article text, gives the empty text; a page
without any tag is all text; an unfinished tag or comment at the end goes. Nothing is capped. Repeated
rows give a row each, other columns don't matter, an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

# Element names of HTML, and words by which pages name parts that are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCK - frozenset("body head html br caption dd dt li option tbody td tfoot th thead title tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NO_ARTICLE = frozenset("head script style noscript template textarea title iframe noembed noframes xmp nav header footer aside form button select input menu dialog svg canvas object audio video".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
NO_ARTICLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies respond pagination pager skip toolbar form search".split()
)
#: Words that, as one part of a longer name, name an article's own matter as often.
WEAK_WORDS = frozenset("related widget form search social header rail skip overlay notice notices".split())

#: What a name takes from a density, and what an ``article`` and a ``main`` add to their rank; the share of the threshold that named parts inside must reach.
NAMED_FACTOR = 0.25
RANK_FACTOR = {"article": 3.0, "main": 2.0}
INSIDE = 0.5

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAMED = re.compile(r"(?i)class|id\s*=|role|hidden|style")
WORD = re.compile(r"[a-z0-9]+")


def _side_share(value: str) -> float:
    """How far a class or id names side matter: 1 for a telling word in one of its names, the share of weaker ones in a name."""
    share = 0.0
    for name in value.split():
        parts = WORD.findall(name)
        found = [w for w in parts if w in NO_ARTICLE_WORDS]
        if found:
            share = max(share, 1.0 if any(w not in WEAK_WORDS for w in found) else len(found) / len(parts))
    return share


def _no_article(tag: str, attributes: str) -> tuple[bool, float]:
    """Whether tag, role or state tell that the element is no article, and how far its class or id does."""
    if tag in NO_ARTICLE:
        return True, 0.0
    if not attributes or not NAMED.search(attributes):
        return False, 0.0
    named = 0.0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            named = max(named, _side_share(value))
        elif name == "role":
            if value in NO_ARTICLE_ROLES:
                return True, named
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True, named
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, named
    return False, named


class _Page:
    """Nodes in document order (parents first), and the texts and breaks with the node each stands in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.named, self.link = ["body"], [-1], [False], [0.0], [False]
        self.parts: list[tuple[int, str | None]] = []
        self._parse(source)
        if 1 in self.named:
            self._drop_named()

    def _open(self, tag: str, attributes: str, at: int) -> int:
        self.tag.append(tag)
        self.parent.append(at)
        out, named = (True, 0.0) if self.out[at] else _no_article(tag, attributes)
        self.out.append(out)
        self.named.append(0.0 if out else named)
        self.link.append(self.link[at] or tag == "a")
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack, pos, end = [0], 0, len(source)
        tags, parts = self.tag, self.parts

        def text(a: int, b: int) -> None:
            if a < b:
                t = source[a:b]
                parts.append((stack[-1], html.unescape(t) if "&" in t else t))

        at_depth: dict[str, list[int]] = {}  # where on the stack each element name is open

        def deepest(names) -> int:
            return max((at_depth[name][-1] for name in names if at_depth.get(name)), default=-1)

        def close(names, scope) -> None:
            depth = deepest(names)
            if depth > deepest(scope):
                for node in stack[depth:]:
                    at_depth[tags[node]].pop()
                del stack[depth:]

        while pos < end:
            m = TOKEN.search(source, pos)
            if not m:
                text(pos, end)
                break
            text(pos, m.start())
            pos = m.end()
            if m[1] is not None:
                parts.append((stack[-1], m[1]))
                continue
            tag = m[3] or m[6]
            if tag is None:
                continue
            tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
            if tag in BLOCK:
                parts.append((stack[-1], None))
            if closing:
                if tag not in VOID and tag not in ("html", "body"):
                    close((tag,), () if tag in BLOCK else ("article", "main", "section", "div", "td", "body"))
            elif tag in ("html", "body"):
                continue
            else:
                if tag in ENDS_P:
                    close(("p",), ("article", "section", "main", "div", "td", "th", "li", "blockquote", "button", "table", "aside", "nav", "footer", "header", "form"))
                if tag in SIBLINGS:
                    close(SIBLINGS[tag], SCOPES[tag])
                node = self._open(tag, attributes, stack[-1])
                if tag in RAW:
                    m = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, pos)
                    pos = m.end() if m else end
                elif tag not in VOID and not attributes.endswith("/"):
                    at_depth.setdefault(tag, []).append(len(stack))
                    stack.append(node)
            if tag in BLOCK:
                parts.append((stack[-1], None))

    def _drop_named(self) -> None:
        """Takes out the elements that a telling class or id names as side matter, but not wrappers of the article."""
        n, parent, out = len(self.tag), self.parent, self.out
        depth, has, chars = [0] * n, [False] * n, [0] * n
        telling = [share == 1 for share in self.named]
        for i in range(1, n):
            depth[i] = depth[parent[i]] + telling[i]
        articles = [i for i in range(n) if not out[i] and self.tag[i] in ("article", "main")]
        for i in articles:
            has[i] = True
        for node, part in self.parts:
            if part:
                chars[node] += len(" ".join(part.split()))
        for i in range(n - 1, 0, -1):
            has[parent[i]] = has[parent[i]] or has[i]
            chars[parent[i]] += chars[i]
        least = min((depth[i] for i in articles), default=None)
        for i in range(1, n):
            wraps = 2 * chars[i] > chars[0] if least is None else has[i] and depth[i] <= least
            out[i] = out[i] or out[parent[i]] or telling[i] and not wraps

    def main_text(self) -> str:
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        out, parent = self.out, self.parent
        for node, part in self.parts:
            if part and not out[node]:
                c = len(" ".join(part.split()))
                chars[node] += c
                if self.link[node]:
                    link_chars[node] += c
        for i in range(n - 1, 0, -1):
            if not out[i]:
                p = parent[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        if not chars[0]:
            return ""
        linked = link_chars[0] / chars[0]
        factor, rank = [1.0] * n, [RANK_FACTOR.get(tag, 1.0) for tag in self.tag]
        for i in range(1, n):
            factor[i] = factor[parent[i]] * (NAMED_FACTOR ** self.named[i] if self.named[i] < 1 else 1.0)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c = chars[i]
            if out[i] or not c:
                continue
            t, lc, lt = tags[i] or 1, link_chars[i] or 1, link_tags[i] or 1
            base = math.log(c / max(c - link_chars[i], 1) * link_chars[i] + linked * c + math.e)
            density[i] = factor[i] * c / t * (math.log(max(c / lc * t / lt, 1.0)) / math.log(base) if base > 1.0001 else math.log(max(c / lc * t / lt, 1.0)) + 1.0)
            sums[i] *= rank[i]
            if i:
                sums[parent[i]] += density[i]
        best = max(range(n), key=lambda i: (sums[i], density[i], -i))
        marked, least, up = [False] * n, density[best], best
        while up >= 0:
            least = min(least, density[up]) if density[up] else least
            up = parent[up]
        marked[best] = True
        if self.tag[best] in RANK_FACTOR:
            for i in range(n):
                if parent[i] == parent[best] and self.tag[i] == "article" and not out[i] and density[i] >= least > 0:
                    marked[i] = True
        else:
            top = list(range(n))  # the largest-ranked node of each subtree
            for i in range(n - 1, 0, -1):
                p = parent[i]
                if sums[top[i]] > sums[top[p]]:
                    top[p] = top[i]
            for i in range(n):
                if not out[i] and density[i] >= least > 0:
                    marked[top[i] if sums[top[i]] > 0 else i] = True
        for i in range(1, n):  # named side matter inside what is text
            if marked[parent[i]] and 0 < self.named[i] < 1 and density[i] < INSIDE * least:
                out[i] = True
            out[i] = out[i] or out[parent[i]]
            marked[i] = marked[i] or marked[parent[i]]
        words = "".join([" " if part is None else part for node, part in self.parts if marked[node] and not out[node]])
        return " ".join(words.split())


def main_text(source: str | None) -> str:
    return _Page(source).main_text() if source else ""


def _extract(at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                texts = [main_text(x.as_py()) for x in some.column(at)]
                yield pa.RecordBatch.from_arrays([*some.columns[:at], pa.array(texts, pa.string())], names=names)

    return run


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all but the page and any ``text``) and ``text``."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (html_col, "text")]
    ahead = df.select(*keep, F.col(html_col).cast("string").alias("__html"))
    schema = df.select(*keep).schema.add("text", "string")
    return ahead.mapInArrow(_extract(len(keep), [*keep, "text"]), schema)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))
