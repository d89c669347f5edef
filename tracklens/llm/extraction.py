"""Operator 12: main text of web pages by the maximum-scoring subsequence of their words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages, about, of which those that mark their main text teach the weights.
FIT_PAGES = 20_000
#: Words for which a prior weight counts, and the largest weight.
PRIOR_WORDS, LARGEST = 50.0, 4.0
#: A feature is learnt if it is on so many pages at least.
LEAST_PAGES = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|xmp|iframe|noframes)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article section div body".split())
#: Elements and names that tell main text or what surrounds it by their meaning, as prior weights.
APART = frozenset("nav aside footer form button select textarea option label menu dialog svg canvas object audio video head title fieldset".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
STRUCTURE = frozenset("ul ol li dl dt dd a table tr td th figure figcaption".split())
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog discussion disqus "
    "dropdown footer form gdpr hidden legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion recommended "
    "related reply respond replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
WITHIN = frozenset("article content entry main post story text".split())
#: A mark of the main text.
MARKS = frozenset(["article", "main"])


@dataclass(slots=True)
class Node:
    """A run of text between tags, or a tag (``words`` 0)."""

    text: str = ""
    words: int = 0
    tag: str = ""
    block: bool = False
    features: tuple[str, ...] = ()
    marked: bool = False
    apart: bool = False


@dataclass(slots=True)
class Element:
    name: str
    features: tuple[str, ...]
    marked: bool
    apart: bool = field(default=False)


def _names(more: str) -> list[str]:
    """Words in class, id and role; hidden elements count as named hidden."""
    out = []
    for m in _NAMED.finditer(more):
        value = m[2] or m[3] or m[4] or ""
        out += ["hidden"] if m[1].lower() == "hidden" else [w.lower() for w in _LETTERS.findall(value)]
    return out


def _marks(name: str, more: str) -> bool:
    return name in MARKS or "articleBody" in more or re.search(r"role\s*=\s*[\"']?main\b", more) is not None


def prior(feature: str) -> float:
    """Log-odds that a word with the feature is main text, before any page is seen."""
    kind, _, name = feature.partition(":")
    if kind == "mark":
        return LARGEST if name == "in" else -LARGEST
    if kind == "name":
        return -3.0 if name in AROUND else 2.0 if name in WITHIN else 0.0
    return -LARGEST if name in APART else -3.0 if name == "header" else 1.0 if name in TEXT else -0.3 if name in STRUCTURE else 0.0


def _around(name: str, names: list[str], inside: bool) -> bool:
    """Whether an element is set apart from the text around it: a menu, a form, a sidebar, a notice and the like."""
    if name in APART or (name == "header" and not inside):
        return True
    return name not in INLINE and name not in ("body", "html") and name not in MARKS | TEXT - {"p"} and any(n in AROUND or (n == "header" and not inside) for n in names)


def nodes(page: str) -> list[Node]:
    """Texts and tags of a page in order, with what holds for them. Comments, scripts and styles are left out."""
    marked_page = any(_marks(m["name"].lower(), m["more"]) for m in _TOKEN.finditer(page) if m["name"] and not m["end"])
    stack: list[Element] = []
    out: list[Node] = []

    def context() -> tuple[tuple[str, ...], bool, bool]:
        inside = any(e.marked for e in stack)
        features = {f for e in stack for f in e.features}
        if marked_page:
            features.add("mark:in" if inside else "mark:out")
        return tuple(sorted(features)), inside, any(e.apart for e in stack)

    def text(raw: str) -> None:
        words = len((raw := html.unescape(raw)).split())
        features, inside, apart = context() if words else ((), False, False)
        out.append(Node(text=raw, words=words, features=features, marked=inside, apart=apart))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not (name := (m["name"] or "").lower()):
            continue
        inside, apart = any(e.marked for e in stack), any(e.apart for e in stack)
        if m["end"]:
            if any(e.name == name for e in stack):
                while stack.pop().name != name:
                    pass
        else:
            if name not in INLINE and any(e.name == "p" for e in stack):
                while stack.pop().name != "p":
                    pass
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name in CLOSES.get(name, ()):
                    del stack[depth:]
                elif stack[depth].name in SCOPES:
                    break
            if name not in VOID and not m["more"].rstrip().endswith("/"):
                names, marks = _names(m["more"]), _marks(name, m["more"])
                tag = [f"tag:{name}"] if name in APART | TEXT | STRUCTURE or (name == "header" and not inside) else []
                stack.append(Element(name, (*tag, *[f"name:{n}" for n in names if n != "header" or not inside]), marks, _around(name, names, inside)))
        out.append(Node(tag=name, block=name not in INLINE or name == "br", marked=inside or _marks(name, m["more"]), apart=apart))
    if at < len(page):
        text(page[at:])
    return out


@dataclass
class Weights:
    """Weights of features of words, and costs of tags."""

    features: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, features: tuple[str, ...]) -> float:
        """Chance that a word is main text, less a half."""
        total = 0.5 + sum(self.features.get(f, prior(f)) for f in features)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))) - 0.5

    def tag(self, name: str) -> float:
        """What a tag takes off: the share of its kind outside of main text."""
        return -self.tags.get(name, 0.9 if name in APART else 0.1)


def region(page: list[Node], weights: Weights) -> tuple[int, int]:
    """The first and last node (exclusive) of the best contiguous region, in one scan: (0, 0) if none has a
    positive score. Of equal regions the first is taken."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    known: dict[tuple[str, ...], float] = {}
    for i, node in enumerate(page):
        # What is set apart in the text is cut afterwards and must not part it: only its first tag counts.
        if node.apart:
            continue
        if node.words:
            if node.features not in known:
                known[node.features] = weights.word(node.features)
            total += node.words * known[node.features]
        elif node.tag:
            total += weights.tag(node.tag)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best region without what is set apart in it; white space in one space, no edges."""
    parts = nodes(page or "")
    first, end = region(parts, weights)
    out = []
    for node in parts[first:end]:
        if node.tag:
            out.append(" " if node.block else "")
        else:
            out.append(" " if node.apart else node.text)
    return " ".join("".join(out).split())


def counted(page: str | None) -> Iterator[tuple[str, int, int]]:
    """(feature or tag, words or tags in the main text, and outside) of a page that marks its main text."""
    parts = nodes(page or "")
    if not any(n.marked for n in parts):
        return
    counts: dict[str, list[int]] = {}
    for node in parts:
        inside = node.marked and not node.apart
        for name in node.features if node.words else [f"cost:{node.tag}"] if node.tag else []:
            counts.setdefault(name, [0, 0])[0 if inside else 1] += node.words or 1
    for name, (within, around) in counts.items():
        yield name, within, around


def fit(pages: DataFrame, sample: int = FIT_PAGES) -> Weights:
    """Weights from the pages of ``pages`` (page_id, url, html) that mark their main text, about ``sample`` pages at most.

    A feature's weight is the log-odds of its words being main text, starting from its prior with the
    weight of PRIOR_WORDS words; features of lists, links and tables stay within 1, as both kinds of text have
    them. Only counts of features leave the tasks; their number is bounded by the sample. Without
    marked pages the priors are all there is.
    """
    share = min(1.0, sample / max(1, pages.count()))
    some = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)) < int(share * (1 << 40))).select("html")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        within, around, seen = Counter(), Counter(), Counter()
        for frame in frames:
            for page in frame["html"]:
                for name, a, b in counted(page):
                    within[name] += a
                    around[name] += b
                    seen[name] += 1
        if names := list(seen):
            yield pd.DataFrame({"name": names, "within": [within[n] for n in names], "around": [around[n] for n in names], "pages": [seen[n] for n in names]})

    sums = some.mapInPandas(count, "name string, within long, around long, pages long").groupBy("name")
    out = Weights()
    for name, a, b in sums.agg(F.sum("within"), F.sum("around"), F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES).drop("pages").collect():
        kind, _, rest = name.partition(":")
        if kind == "cost":
            out.tags[rest] = min(0.9, max(0.05, (b + PRIOR_WORDS * 0.1) / (a + b + PRIOR_WORDS)))
            continue
        before = 1 / (1 + math.exp(-prior(name)))
        limit = 1.0 if kind == "tag" and rest in STRUCTURE | TEXT else LARGEST
        out.features[name] = max(-limit, min(limit, math.log((a + PRIOR_WORDS * before) / (b + PRIOR_WORDS * (1 - before)))))
    return out


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A page is a sequence of words and tags. A word scores by the learnt weights of what it stands in, a
    tag takes off; the main text is the contiguous region of the highest sum. Parts in it that are set apart
    (menus, forms, sidebars, notices, adverts, comments of readers) are cut, scripts, styles and markup are never
    text. Character references are decoded; a block's white space becomes one space, blocks are
    joined by one space, words broken by inline tags are whole.

    Null and empty pages, and those without main text, give an empty text. Null and repeated ids stay as they
    are; pages of any length are taken whole; unclosed elements end with what they are in. Other
    columns are ignored. No shuffle.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page, weights) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


#: The same rows in DuckDB for pages whose article is one element with nothing set apart in it.
ORACLE_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS text FROM pages
), d AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS text FROM a
), t AS (
  SELECT page_id, url, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM d
)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
