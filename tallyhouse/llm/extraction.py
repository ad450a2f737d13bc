"""Main text of web pages from flat text blocks, classified by a decision tree.

Method. A page is cut at the borders of block elements into flat text blocks. The features of a block are its number of
words and the link density (share of words inside links), the same two of the blocks before and after it, and its place: 2 inside
an article, 0 outside the articles of a page or in an element of a kind that holds no main text (menu, header, footer, sidebar,
notice, advert, form, comments), 1 elsewhere on a page without articles. A kind is told by the element, the role, or a
whole class or id: one word of the kind, alone or with words that only name a place (``site-nav``, ``comment-list``), not a word that is part of
another name (``share-price``) or tells what the element has or lacks (``with-sidebar``, ``no-comments``). On an element that is itself an article
(by element, role, or a whole class or id) only a single word counts, or one joined to the article's (``story-footer``); what
it is filed under (``category-privacy``) does not. A decision tree is trained on the small labelled
table of ``labelled_pages`` and decides block by block. Where markup tells nothing, as on pages without articles, it decides by words and link density of
a block and of its neighbours: a link between paragraphs stays, a line of words between lists of links goes.

Scripts, styles, the head, hidden elements and markup are no text. Character references are decoded, white space
inside a block becomes one space, blocks are joined by a newline in page order, nothing is cut off.

Defined results: a null or empty page, and a page without main text, has an empty text; broken markup is read like
browsers read it in simple cases (unclosed elements end with their parent, unknown end tags are ignored,
an unclosed comment, script or style takes the rest of the page); repeated rows get repeated results; extra columns are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.labelled_pages import PAGES

# Elements and words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
NO_TEXT = RAW | frozenset(("head", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "map", "option", "datalist"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset(("html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "figcaption"))
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
        "thead": ("tr", "td", "th", "caption"), "tbody": ("thead", "tr", "td", "th", "caption"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist")}
ASIDE_ELEMENTS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "search"))
ASIDE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"))
ASIDE_WORDS = frozenset(
    "ad adbox ads adv advert adverts advertisement advertising advertorial alert banner blogroll breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer discuss discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation navi "
    "newsletter notice notices notification overlay pager pagination paywall popular popup privacy promo promoted promotion promotions rail recommended "
    "recommendations related replies reply respond responses share sharing side sidebar sidebars sidenav signup skip social sponsor sponsored sponsors "
    "subscribe subscription tags teaser teasers toolbar topbar topnav trending widget widgets".split())
# Words that only say where an element stands; with them and words of one kind alone a name is of that kind (``site-nav``, ``comment-list``).
PLACE_WORDS = frozenset(
    "area bar bars block blocks blog bottom box boxes button buttons category categories col column container content desktop first fixed global group icon icons inline "
    "inner item items last left link links list lists lower main mobile more outer page panel post posts primary right row secondary section sections site slot sticky "
    "sub text title top upper user users web wrap wrapper".split())
MAIN_WORDS = frozenset(("article", "articlebody", "entry", "story"))

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place")
# Names, quotes and rests are matched without giving back, so that broken markup costs one pass.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_HAS = re.compile(r"(?:^|(?<=[-_]))(?:has|no|with|without)[-_].*")
_FILED = ("category-", "tag-")
_KNOWN = ASIDE_WORDS | PLACE_WORDS | MAIN_WORDS
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _facts(name: str, rest: str) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, aside of the main text, or an article."""
    aside, inside, hidden = name in ASIDE_ELEMENTS, name in ("article", "main"), False
    main, part, joint, whole = inside, False, False, False
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for token in value.split():
                    named = set(_WORD.findall(_HAS.sub("", _CAMEL.sub("-", token).lower())))
                    if not ASIDE_WORDS.isdisjoint(named) and named <= _KNOWN:
                        part = True
                        whole |= token.lower() in ASIDE_WORDS
                        joint |= not MAIN_WORDS.isdisjoint(named) and not token.lower().startswith(_FILED)
                    inside |= not MAIN_WORDS.isdisjoint(named)
                    main |= token.lower() in MAIN_WORDS
            elif key == "role":
                aside |= value.lower() in ASIDE_ROLES
                main |= value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    if name not in ("article", "main"):
        whole |= joint
    inside |= main
    aside |= whole if main else part
    return hidden, aside and name not in ("html", "body"), inside and name not in ("html", "body")


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Text blocks in page order: text, words, words in links, aside, inside."""
    found: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, hidden, aside, inside; the last three with all above
    places: dict[str, list[int]] = {}  # depths of the open elements of each name, so that no search walks the stack
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t.split()) for t, a in parts if a)
                _, _, aside, inside = stack[-1] if stack else ("", False, False, False)
                found.append((text, text.count(" ") + 1, linked, aside, inside))
            parts.clear()

    def pop_to(depth: int) -> None:
        nonlocal links
        gone = [n for n, *_ in stack[depth:]]
        if any(n in BLOCK or n in NO_TEXT for n in gone):
            flush()
        for n in gone:
            links -= n == "a"
            places[n].pop()
        del stack[depth:]

    def last(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        d = last(names)
        if d >= 0 and d > last(tuple(n for n in scope if n not in names)):
            pop_to(d)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1][1]):
            parts.append((html_lib.unescape(page[at:stop]), links > 0))
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "p" and not places.get("p"):
                flush()
            close((name,), ("body",) if name not in ("body", "html") else ())
            continue
        rest = m[3] or ""
        if name == "br" or name == "wbr":
            if name == "br":
                parts.append((" ", links > 0))
            continue
        if name == "body":
            close(("head",))
        if name in CLOSES_P:
            close(("p",), ("td", "th", "body", "button"))
        if name in SAME:
            close(SAME[name], SCOPE.get(name, ("table",)))
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if name in RAW and not rest.rstrip().endswith("/"):
            # Raw text: nothing inside is markup or text.
            done = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I).search(page, at)
            at = done.end()
            continue
        hidden, aside, inside = _facts(name, rest)
        if stack:
            _, h, a, i = stack[-1]
        else:
            h = a = i = False
        if name in NO_TEXT:
            flush()
            hidden = True
        places.setdefault(name, []).append(len(stack))
        stack.append((name, h or hidden, a or aside, i or inside))
        if name == "a":
            links += 1
    flush()
    return found


def features(found: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    """One row of ``FEATURES`` per block."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b[1] for b in found], dtype=np.float64)
    density = np.minimum(np.array([b[2] for b in found]) / words, 1.0)
    aside, inside = (np.array([b[i] for b in found], dtype=np.float64) for i in (3, 4))
    before, after = (lambda x: np.r_[0.0, x[:-1]]), (lambda x: np.r_[x[1:], 0.0])
    main = inside * (1 - aside)
    place = 2 * main if main.any() else 1 - aside
    return np.stack([words, density, before(words), before(density), after(words), after(density), place], axis=1)


def training_table(spark: SparkSession, pages: tuple[str, ...] = PAGES) -> DataFrame:
    """Labelled blocks of the small table."""
    rows = []
    for page in pages:
        found = blocks(page)
        marked = [b[0].startswith("+") for b in found]
        rows += [(f.tolist(), float(y)) for f, y in zip(features(found), marked)]
    return spark.createDataFrame(rows, "features array<double>, label double")


class Tree:
    """A fitted decision tree as nested tuples (feature, threshold, left, right) or a class."""

    def __init__(self, root):
        self.root = root

    @classmethod
    def fit(cls, labelled: DataFrame, depth: int = 6) -> Tree:
        model = DecisionTreeClassifier(maxDepth=depth, seed=1, impurity="gini", minInstancesPerNode=1, maxBins=64).fit(
            labelled.select("label", array_to_vector("features").alias("features")))

        def read(node):
            if node.getClass().getSimpleName() == "LeafNode":
                return node.prediction() > 0.5
            return node.split().featureIndex(), node.split().threshold(), read(node.leftChild()), read(node.rightChild())

        return cls(read(model._java_obj.rootNode()))

    def decide(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)

        def walk(node, rows):
            if isinstance(node, bool):
                out[rows] = node
                return
            low = x[rows, node[0]] <= node[1]
            walk(node[2], rows[low])
            walk(node[3], rows[~low])

        walk(self.root, np.arange(len(x)))
        return out


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page) if page else []
    keep = tree.decide(features(found))
    return "\n".join(b[0] for b, k in zip(found, keep.tolist()) if k)


def extract(pages: DataFrame, html: str = "html", out: str = "text", tree: Tree | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) and the main text of each page."""
    tree = tree or Tree.fit(training_table(pages.sparkSession))
    keep = [c for c in (pages.columns if keep is None else keep) if c != out]
    own = [f"c{i}" for i in range(len(keep))]
    flat = pages.select(F.col(html).alias("html"), *[F.col(c).alias(o) for c, o in zip(keep, own)])
    kinds = dict(flat.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = pa.array([main_text(x, tree) for x in part.column(part.schema.get_field_index("html")).to_pylist()], type=pa.string())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in own] + [texts], names=[*own, "text"])

    done = flat.mapInArrow(run, "".join(f"{o} {kinds[o]}, " for o in own) + "text string")
    return done.select(*[F.col(o).alias(c) for o, c in zip(own, keep)], F.col("text").alias(out))
