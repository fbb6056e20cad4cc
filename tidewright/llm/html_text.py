"""Main text of web pages from flat text blocks.

A page is cut at block-level tags into a flat list of blocks. A block is described by its words and link density,
those of its neighbours, whether it is a heading, and what the elements around it say. A decision tree tells whether
it belongs to the article. Tree and signs are learned from a small table of labelled blocks: how much more often the
article lies in an element of some name, class, id or role is counted there and nowhere written down. Names that the
table lacks are judged by their words, whose signs are learned from the names in it.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.common import map_texts, once
from tidewright.llm.html_labels import BLOCKS

#: Elements whose content is never text of the page (of the first kind without an end all that follows is content, of the second nothing), those inside
#: a line of text, and those that say nothing by their name.
RAW, DROPPED = frozenset("script style noscript template iframe title textarea".split()), frozenset(["svg", "select"])
INLINE = frozenset("a abbr acronym area audio b base bdi bdo big canvas cite code col data del dfn em embed font i img input ins kbd label link mark math meta object param picture q rp rt ruby s samp select small source span strike strong sub sup svg time track tt u var video wbr".split())
PLAIN = frozenset("blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 html li ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose classes say nothing of what lies in them, and those that make a form around them the wrapper of a page.
WHOLE, WRAPPED = frozenset(["html", "body", "main", "article"]), frozenset(["main", "article", "h1"])
#: Blocks of hidden elements that are added to the table, all outside the article.
SHOWN_NEVER = 5
NONE = 1 << 60
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: Where a word in the middle of a name begins with a capital.
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "least_sign", "greatest_sign")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    least: float
    greatest: float


def names(tag: str, attributes: str) -> set[str]:
    """What an element calls itself: its tag, and whole classes, id and role."""
    found = set() if tag in PLAIN else {f"<{tag}>"}
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            found.add("[hidden]")
        elif name in ("class", "id", "role") and tag not in WHOLE:
            found.update(HUMP.sub("-", m[2] or m[3] or m[4] or "").replace("_", "-").lower().split())
    return found


def parts_of(name: str) -> set[str]:
    """The words that a name is made of, without digits and plural."""
    return {x.rstrip("s") or x for x in re.split(r"[^a-z]+", name) if x}


def signs(found: set[str], odds: dict[str, float]) -> tuple[float, float]:
    """The least and the greatest sign of an element's names, 0 at most and at least. A name that the table lacks has the sum of its words' signs."""
    known = [odds[x] if x in odds else sum(odds.get(f"~{p}", 0.0) for p in parts_of(x)) for x in found]
    return min(0.0, *known, 0.0), max(0.0, *known, 0.0)


def blocks(page: str, odds: dict[str, float]) -> list[Block]:
    """The non-empty text blocks of a page, in order; one pass, linear in its length."""
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    stack: list[tuple[str, tuple[float, float], tuple[float, float]]] = []  # enclosing elements, their signs, and those of all outside
    least = greatest = 0.0
    opened: Counter[str] = Counter()  # how often each element is on the stack
    endless: set[str] = set()  # elements of which no end follows
    heading, depth_a, form, at = False, 0, NONE, 0  # form: the place of the outermost one that may yet prove to be a page's wrapper

    def flush() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), len("".join(link_parts).split()), heading, least, greatest))
            parts.clear()
            link_parts.clear()

    def say(s: str) -> None:
        parts.append(s)
        if depth_a:
            link_parts.append(s)

    while m := TOKEN.search(page, at):
        if m.start() > at:
            s = page[at : m.start()]
            say(html.unescape(s) if "&" in s else s)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW or tag in DROPPED:
            if not m[1] and not (tag == "svg" and m[3].endswith("/")) and tag not in endless:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end or tag in RAW:
                    at = end.end() if end else len(page)
                else:
                    endless.add(tag)
        elif tag == "a":
            depth_a = 0 if m[1] else 1
            if m[1]:
                link_parts.append(" ")
        elif tag == "br":
            say(" ")
        elif tag not in INLINE:
            flush()
            depth_a = 0
            if not m[1] and tag in WRAPPED and form < len(stack):
                least, greatest = stack[form][2]
                for i in range(form, len(stack)):
                    name, own, _ = stack[i]
                    own = (0.0, 0.0) if name == "form" else own
                    stack[i] = (name, own, (least, greatest))
                    least, greatest = min(least, own[0]), max(greatest, own[1])
                form = NONE
            if tag in HEADINGS:
                heading = not m[1]
            elif tag == "p" or tag == "hr":
                heading = False
            elif m[1]:
                while opened[tag]:
                    name, _, (least, greatest) = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
                form = form if form < len(stack) else NONE
            elif not m[3].endswith("/"):
                own = signs(names(tag, m[3]), odds)
                form = min(form, len(stack)) if tag == "form" else form
                stack.append((tag, own, (least, greatest)))
                opened[tag] += 1
                least, greatest = min(least, own[0]), max(greatest, own[1])
    if at < len(page):
        s = page[at:]
        say(html.unescape(s) if "&" in s else s)
    flush()
    return out


def describe(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in found], dtype=np.float64)
    density = np.array([b.linked for b in found]) / words
    before, after = (lambda x: np.r_[0.0, x[:-1]]), (lambda x: np.r_[x[1:], 0.0])
    own = np.array([[b.heading, b.least, b.greatest] for b in found], dtype=np.float64)
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), own])


# -- tree -----------------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A tree by Gini impurity: (feature, threshold, below, above) or the share of ones. Ties go to the first feature."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = (share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            n, m = int(low.sum()), int((~low).sum())
            if min(n, m) >= least:
                p, q = y[low].mean(), y[~low].mean()
                if (cost := n * p * (1 - p) + m * q * (1 - q)) < best[0]:
                    best = (cost, f, t)
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, x: np.ndarray) -> np.ndarray:
    """The tree's share of ones for each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, below, above = tree
    low = x[:, f] <= t
    out = np.empty(len(x))
    out[low], out[~low] = decide(below, x[low]), decide(above, x[~low])
    return out


def labelled(table: str = BLOCKS) -> list[list[tuple[bool, list[tuple[str, set[str]]], int, int]]]:
    """The pages of a table of labelled blocks: for each block its label, the elements around it with their names, words and words in links."""
    pages: list[list] = []
    for page in table.strip().split("\n\n"):
        pages.append([])
        for line in page.split("\n"):
            label, path, words, linked = line.split()
            around = [(x.split(".")[0], {*x.split(".")[1:]}) for x in path.split("/")]
            around = [(tag, (set() if tag in WHOLE else own) | (set() if tag in PLAIN else {f"<{tag}>"})) for tag, own in around]
            pages[-1].append((label == "+", around, int(words), int(linked)))
    return pages


def learn_signs(pages: list) -> dict[str, float]:
    """For each name of an element the log ratio of the share of article blocks to that of others in it."""
    inside = {True: Counter(), False: Counter(["[hidden]"] * SHOWN_NEVER)}
    total = Counter(label for page in pages for label, *_ in page)
    for page in pages:
        for label, around, _, _ in page:
            inside[label].update(set().union(*(own for _, own in around)))
    odds = {x: math.log((inside[True][x] + 0.5) / (total[True] + 1)) - math.log((inside[False][x] + 0.5) / (total[False] + 1)) for x in sorted(inside[True] | inside[False])}
    return odds | {f"~{x}": w for x, w in word_signs(inside).items()}


def word_signs(inside: dict[bool, Counter], prior: float = 0.3) -> dict[str, float]:
    """For each word in names of elements its weight in a logistic regression of article blocks on the words of a name around them.

    So a word that turns another's meaning ("no", "open") gets the weight that does so, and names made of known words in other ways have a sign too.
    """
    names = sorted(x for x in inside[True] | inside[False] if x[0] not in "<[")
    words = sorted(set().union(*map(parts_of, names)))
    x = np.array([[w in parts_of(name) for w in words] for name in names], dtype=np.float64)
    yes, no = (np.array([inside[label][name] for name in names], dtype=np.float64) for label in (True, False))
    weights = np.zeros(len(words))
    for _ in range(20):  # Newton's method; the loss is convex
        p = 1 / (1 + np.exp(-x @ weights))
        slope = x.T @ (yes - (yes + no) * p) - prior * weights
        weights = weights + np.linalg.solve((x.T * ((yes + no) * p * (1 - p))) @ x + prior * np.eye(len(words)), slope)
    return dict(zip(words, weights.tolist(), strict=True))


def train(table: str = BLOCKS):
    """Signs and a tree from labelled blocks."""
    pages = labelled(table)
    odds, rows, labels = learn_signs(pages), [], []
    for page in pages:
        found = []
        for label, around, words, linked in page:
            own = [signs(x, odds) for _, x in around]
            found.append(Block("", words, linked, around[-1][0] in HEADINGS, min(x for x, _ in own), max(x for _, x in own)))
            labels.append(label)
        rows.append(describe(found))
    return odds, grow(np.concatenate(rows), np.array(labels, dtype=np.float64))


def main_text(page: str | None, model) -> str:
    odds, tree = model
    found = blocks(page, odds) if page else []
    return "\n\n".join(b.text for b, p in zip(found, decide(tree, describe(found)), strict=True) if p >= 0.5)


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep`, text and n_chars (code points) of every page.

    A null or empty page, or one without an article, has an empty text. A very long page is read in one pass, with
    memory in proportion to it. Repeated pages stay, other columns are left out, an empty table gives an empty result.
    """
    model, key = train(), uuid.uuid4().hex

    def make():
        trained = once(key, lambda: model)

        def run(texts: list) -> list:
            found = [main_text(t, trained) for t in texts]
            return [found, list(map(len, found))]

        return run

    return map_texts(pages, make, [("text", "string"), ("n_chars", "long")], column, keep)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
