"""Main text of HTML pages by tag-path ratios.

A page is read as a row of text nodes, each with its root-to-leaf path of block elements. For each path the text length
and the punctuation of its nodes are summed and divided by their number; both ratios are written back to the nodes,
smoothed along the page by a Gaussian window, fused by a geometric mean, averaged over each path again, and paths below
a share of the page's mean (by characters) are left out. Paths through elements that never hold an article (navigation, footers,
scripts) start at zero; where a page has article or main elements, so do paths outside of the one with the largest fused
mass. Names of containers (class, id, role) that are usual for other parts, and forms, are a prior only: each weighs the
paths below it by PRIOR against the rest of the page, so that a wrapper around all of it changes nothing.

Paths are numbers: a node holds one, which stands for the path above it and its element's name, so a page's memory
follows its length at any depth.

Defined results: null, empty and text-only html give the text that stands outside of tags (empty if none); unclosed and
misnested elements are closed by the next block that cannot stand inside them; very long pages are read whole; equal
pages give equal texts, and paths of equal scores fare alike; an empty table gives an empty result; only page_id, url
and html are read, whatever other columns there are.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches

KEEP = 0.1
#: Weight of a path for each container above that is named like another part of a page: once where a part of a name says
#: so (has-sidebar), twice where a whole name does (sidebar).
PRIOR = 0.02
SIGMA, REACH = 1.5, 4
#: Fixed values of HTML: elements whose content is no text, without content, inline, and that close an open paragraph.
RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|select|button|title|audio|video"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
NO_ARTICLE = frozenset("nav footer aside menu dialog head".split())
#: Names (in class, id or role) of containers that mostly hold no part of an article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|paywall|signup|login"
    r"|sidebar|sidenav|rail|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|share|sharing|social|related|recommended|recommendations|trending|widget|tags|comments?|commentlist|discussion|respond|replies|reply|disqus"
    r"|foot|footer|masthead|contentinfo|complementary|search|skip|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_OTHER_ARTICLE = re.compile(r"comment|related|teaser|promo|sponsor", re.I)
_PUNCT = re.compile(r"""[.,;:!?…。，、；：！？"'()«»“”-]""")


_LISTED = frozenset(("li", "dt", "dd", "tr", "td", "th", "option"))
_LISTS = frozenset(("ul", "ol", "dl", "table", "menu", "select"))
#: Open elements of these kinds end where the next one begins.
_ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}


@dataclass(slots=True)
class Node:
    path: int
    main: int
    named: int
    text: str
    block: int


def _naming(label: str) -> int:
    """2 where one of the names is that of another part as a whole, 1 where one has such a part, else 0."""
    if not NAMED.search(label):
        return 0
    return 2 if any(NAMED.fullmatch(x) for x in label.split()) else 1


class _Stack:
    """Open block elements: of each its name, path, main number and how many named containers it is in."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.state: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.open: Counter[str] = Counter()
        self.paths: dict[tuple[int, str], int] = {}

    def push(self, name: str, main: int, named: int) -> None:
        path = self.paths.setdefault((self.state[-1][0], name), len(self.paths) + 1)
        self.names.append(name)
        self.state.append((path, main, named))
        self.open[name] += 1

    def cut(self, k: int) -> None:
        """Closes the k-th element and all in it."""
        for name in self.names[k:]:
            self.open[name] -= 1
        del self.names[k:], self.state[k + 1 :]

    def last(self, name: str) -> int:
        """Place of the innermost open element of the name, -1 if none."""
        if not self.open[name]:
            return -1
        k = len(self.names) - 1
        while self.names[k] != name:
            k -= 1
        return k


def nodes_of(page: str) -> list[Node]:
    """Text nodes with their paths of block elements; main: number of the article or main element they are in, -1 where
    they cannot belong to an article, 0 outside; named: containers around them that are named like other parts; block:
    number of the block."""
    found: list[Node] = []
    stack = _Stack()
    block = mains = at = 0

    def text(s: str) -> None:
        if s:
            path, main, named = stack.state[-1]
            found.append(Node(path, main, named, s, block))

    for m in _TOKEN.finditer(page):
        text(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if name in VOID:
            block += name in ("br", "hr")
            if name == "br" and at < len(page):
                text(" ")
            continue
        block += 1
        if m["close"]:
            if (k := stack.last(name)) >= 0:
                stack.cut(k)
            continue
        if name in ENDS_PARAGRAPH and (k := stack.last("p")) >= 0 and not any(x in ("td", "th") for x in stack.names[k:]):
            stack.cut(k)
        if name in _LISTED:
            # an open one of the same kind in the same list or table ends here
            alike = _ALIKE.get(name, (name,))
            if any(stack.open[x] for x in alike):
                k = len(stack.names) - 1
                while k >= 0 and stack.names[k] not in _LISTS:
                    if stack.names[k] in alike:
                        stop = name != "tr" or stack.names[k] == "tr"
                        stack.cut(k)
                        if stop:
                            break
                    k -= 1
        if name == "body" and (k := stack.last("head")) >= 0:
            stack.cut(k)
        _, above, named = stack.state[-1]
        attrs = m["attrs"] or ""
        labels = [a or b or c for a, b, c in _NAMES.findall(attrs)] if "=" in attrs else []
        if name in ("article", "main"):
            named += any(_OTHER_ARTICLE.search(x) for x in labels)
        elif name not in ("html", "body"):
            named += max([int(name == "form"), *map(_naming, labels)])
        main = above
        if above == -1 or name in NO_ARTICLE or name == "header" and above == 0:
            main = -1
        elif name in ("article", "main") and above == 0:
            mains += 1
            main = mains
        if not (attrs.rstrip().endswith("/") and name not in ENDS_PARAGRAPH):
            stack.push(name, main, named)
    text(entities.unescape(page[at:]))
    return found


def path_scores(of: np.ndarray, size: np.ndarray, marks: np.ndarray, prior: np.ndarray, paths: int) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes in page order with their paths' numbers the fused ratio, and of each path the score. size, marks: length
    and punctuation of each node; prior: its weight."""
    count = np.bincount(of, minlength=paths)
    lengths, punct = (np.bincount(of, size, paths) / count)[of], (np.bincount(of, marks, paths) / count)[of]
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    near = lambda x: np.convolve(x, kernel, "full")[REACH:-REACH]
    weight = near(prior)
    fused = np.sqrt(near(lengths * prior) / weight * (1 + near(punct * prior) / weight))
    return fused, np.bincount(of, fused * prior, paths) / count


def main_text(page: str) -> str:
    nodes = nodes_of(page)
    live = [n for n in nodes if n.main >= 0 and n.text.strip()]
    if not live:
        return ""
    paths: dict[tuple[int, int, int], int] = {}
    of = np.array([paths.setdefault((n.path, n.main, n.named), len(paths)) for n in live])
    size = np.array([len(n.text.strip()) for n in live], float)
    marks = np.array([len(_PUNCT.findall(n.text)) for n in live], float)
    # against the least named node, so that a wrapper around the whole page weighs nothing
    named = np.array([n.named for n in live])
    prior = PRIOR ** np.minimum(named - named.min(), 8).astype(float)
    fused, score = path_scores(of, size, marks, prior, len(paths))
    group = np.array([n.main for n in live])
    inside = np.ones(len(live), bool)
    if group.max() > 0:
        mass = np.bincount(group, fused * size * prior, minlength=group.max() + 1)
        inside = group == 1 + int(np.argmax(mass[1:]))
    # the mean by characters: many short nodes don't lower it
    weight = (prior * size)[inside]
    least = KEEP * (fused[inside] * weight).sum() / weight.sum()
    chosen = {(n.path, n.main, n.named) for n, yes in zip(live, inside & (score[of] >= least)) if yes}
    out, last = [], None
    for n in nodes:
        if (n.path, n.main, n.named) in chosen:
            if last is not None and n.block != last:
                out.append(" ")
            out.append(n.text)
            last = n.block
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page, in one pass without a shuffle."""
    bound_batches(pages.sparkSession)
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
