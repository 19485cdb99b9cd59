"""Main text of web pages: flat text blocks, classified by a decision tree over them and their neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# One piece of markup. Attributes are taken one after the other and never given back, and what is cut off
# ends with the page, so a tag is read twice at most. Where quotes do not pair a tag ends at the next ">".
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^<>]*+)(?:>|\Z)",
    re.S,
)
CLASSES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Elements by how they lay out, and names that page furniture goes by.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "select", "button", "math", "object", "canvas"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MAIN = {"article", "main"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
FURNITURE_NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie",
    "cookies", "consent", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pagination",
    "popup", "promo", "related", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# Elements that are laid around whole articles, too.
WRAPPERS = {"header", "fieldset", "dialog"}
# Words in a class that say what an element holds or lacks, not what it is, and those that begin the name of an article's own parts.
LAYOUT = {"has", "with", "no", "without", "layout"}
OWN_PARTS = {"entry", "post", "article", "story"}
# Names that also say where something stands in a layout, and those whose compounds may as well be about the text.
STRUCTURAL = {
    "banner", "breadcrumb", "breadcrumbs", "complementary", "contentinfo", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation",
    "pagination", "sidebar", "toolbar", "widget",
}
AMBIGUOUS = STRUCTURAL | {"notice", "related", "share", "sharing", "social"}

FEATURES = ("words", "density", "before_words", "before_density", "after_words", "after_density", "main", "furniture", "named", "share")

# Labelled by hand: words and share of linked words of a block, of the block
# before and the block after, whether a main element and whether a furniture
# element holds it, and the label: 1 for the article, 0 for the rest.
UNNAMED = (
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 12, 0.0, 0, 1, 0),
    (12, 0.0, 2, 1.0, 9, 0.0, 0, 1, 0), (14, 0.0, 1, 1.0, 60, 0.0, 0, 1, 0), (45, 0.0, 1, 1.0, 80, 0.0, 0, 1, 0),
    (9, 0.0, 14, 0.0, 70, 0.0, 1, 0, 1), (6, 0.0, 12, 0.0, 4, 0.0, 1, 0, 1), (2, 0.0, 40, 0.0, 50, 0.0, 1, 0, 1),
    (70, 0.0, 9, 0.0, 85, 0.02, 1, 0, 1), (85, 0.02, 70, 0.0, 8, 0.0, 1, 0, 1), (8, 0.0, 85, 0.0, 11, 0.0, 1, 0, 1),
    (1, 0.0, 30, 0.0, 30, 0.0, 1, 0, 1), (30, 0.4, 60, 0.0, 20, 0.0, 1, 0, 1), (5, 1.0, 60, 0.0, 20, 0.0, 1, 0, 1),
    (40, 0.1, 0, 0.0, 0, 0.0, 1, 0, 1), (300, 0.0, 10, 0.0, 12, 0.3, 1, 0, 1), (3, 0.0, 2, 0.0, 2, 0.0, 1, 0, 1),
    (11, 0.0, 8, 0.0, 0, 0.0, 0, 1, 0), (20, 0.1, 85, 0.0, 0, 0.0, 0, 1, 0), (60, 0.0, 85, 0.0, 5, 1.0, 0, 1, 0),
    (25, 0.0, 30, 0.0, 28, 0.0, 1, 1, 0), (7, 0.0, 60, 0.0, 25, 0.0, 1, 1, 0), (80, 0.0, 5, 0.0, 4, 1.0, 1, 1, 0),
    (4, 1.0, 60, 0.0, 3, 1.0, 1, 1, 0), (2, 1.0, 50, 0.0, 60, 0.0, 1, 1, 0), (120, 0.0, 120, 0.0, 120, 0.0, 0, 1, 0),
    (60, 0.0, 0, 0.0, 70, 0.0, 0, 0, 1), (70, 0.05, 60, 0.0, 40, 0.0, 0, 0, 1), (25, 0.0, 70, 0.0, 60, 0.0, 0, 0, 1),
    (18, 0.0, 40, 0.0, 20, 0.0, 0, 0, 1), (12, 0.0, 30, 0.0, 40, 0.0, 0, 0, 1), (8, 0.0, 25, 0.0, 50, 0.0, 0, 0, 1),
    (40, 0.0, 8, 0.0, 0, 0.0, 0, 0, 1), (20, 0.0, 60, 0.0, 3, 1.0, 0, 0, 1), (90, 0.2, 40, 0.0, 35, 0.1, 0, 0, 1),
    (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1), (9, 0.0, 1, 1.0, 45, 0.0, 0, 0, 1), (35, 0.0, 3, 1.0, 3, 1.0, 0, 0, 1),
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0), (5, 0.8, 60, 0.0, 4, 1.0, 0, 0, 0), (12, 0.7, 30, 0.0, 8, 0.9, 0, 0, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 0.0, 0, 0, 0), (6, 0.0, 4, 1.0, 5, 0.5, 0, 0, 0),
    (10, 0.5, 2, 1.0, 3, 1.0, 0, 0, 0), (20, 0.6, 20, 0.6, 20, 0.6, 0, 0, 0), (30, 0.9, 10, 1.0, 10, 1.0, 0, 0, 0),
    (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0), (8, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0), (5, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0),
    (60, 0.5, 60, 0.0, 60, 0.0, 0, 0, 0), (15, 0.4, 3, 1.0, 2, 1.0, 0, 0, 0), (1, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0),
    # Paragraphs of a main element before links, whatever their length, and the links after them.
    (20, 0.0, 60, 0.0, 5, 1.0, 1, 0, 1), (20, 0.0, 30, 0.0, 5, 1.0, 1, 0, 1), (8, 0.0, 40, 0.0, 12, 1.0, 1, 0, 1),
    (3, 0.0, 8, 0.0, 4, 1.0, 1, 0, 1), (30, 0.0, 20, 0.1, 6, 0.9, 1, 0, 1), (12, 0.0, 5, 1.0, 6, 1.0, 1, 0, 1),
    (10, 0.0, 0, 0.0, 8, 0.8, 1, 0, 1), (6, 0.0, 70, 0.0, 1, 1.0, 1, 0, 1), (4, 1.0, 20, 0.0, 5, 1.0, 1, 0, 0),
    (4, 1.0, 5, 1.0, 5, 1.0, 1, 0, 0), (6, 0.9, 12, 0.0, 3, 1.0, 1, 0, 0), (3, 1.0, 4, 1.0, 6, 0.8, 1, 0, 0),
    # Short last paragraphs of an article that no main element holds.
    (20, 0.0, 40, 0.0, 4, 1.0, 0, 0, 1), (16, 0.0, 30, 0.0, 4, 1.0, 0, 0, 1), (22, 0.0, 25, 0.0, 6, 0.9, 0, 0, 1),
    (12, 0.0, 50, 0.0, 5, 1.0, 0, 0, 1), (18, 0.0, 50, 0.0, 0, 0.0, 0, 0, 1), (20, 0.0, 45, 0.0, 2, 0.0, 0, 0, 1),
    (14, 0.0, 30, 0.0, 0, 0.0, 0, 0, 1), (10, 0.0, 60, 0.0, 1, 0.0, 0, 0, 1),
    (40, 0.0, 3, 1.0, 0, 0.0, 1, 0, 1), (15, 0.0, 3, 1.0, 2, 1.0, 1, 0, 1), (9, 0.0, 5, 1.0, 0, 0.0, 1, 0, 1), (60, 0.0, 3, 1.0, 0, 0.0, 0, 0, 1),
    (8, 0.0, 3, 1.0, 0, 0.0, 1, 0, 1), (8, 0.0, 0, 0.0, 40, 0.0, 1, 0, 1), (8, 0.0, 5, 0.0, 30, 0.0, 1, 0, 1), (15, 0.4, 30, 0.0, 20, 0.0, 1, 0, 1),
    (12, 0.35, 20, 0.0, 30, 0.0, 1, 0, 1), (20, 0.4, 10, 0.0, 40, 0.0, 1, 0, 1), (14, 0.4, 3, 1.0, 2, 1.0, 1, 0, 1), (8, 0.0, 60, 0.0, 30, 0.0, 0, 0, 1),
    # Headings, captions and list items of a main element.
    (4, 0.0, 6, 0.0, 5, 0.0, 1, 0, 1), (5, 0.0, 4, 0.0, 6, 0.0, 1, 0, 1), (7, 0.0, 50, 0.0, 40, 0.0, 1, 0, 1), (2, 0.0, 30, 0.0, 3, 1.0, 1, 0, 1),
    (5, 0.0, 3, 1.0, 20, 0.0, 1, 0, 1), (6, 0.0, 0, 0.0, 70, 0.0, 1, 0, 1), (1, 0.0, 5, 1.0, 30, 0.0, 1, 0, 1), (3, 0.0, 4, 1.0, 2, 0.0, 1, 0, 1),
    # Headings before a long paragraph and paragraphs with links, where no main element holds them.
    (3, 0.0, 4, 1.0, 80, 0.0, 0, 0, 1), (2, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1), (4, 0.0, 50, 0.0, 70, 0.0, 0, 0, 1), (5, 0.0, 70, 0.0, 45, 0.0, 0, 0, 1),
    (40, 0.4, 60, 0.0, 30, 0.0, 0, 0, 1), (25, 0.35, 30, 0.0, 50, 0.0, 0, 0, 1), (50, 0.4, 20, 0.0, 40, 0.1, 0, 0, 1),
    (20, 0.4, 30, 0.0, 4, 1.0, 1, 0, 1), (16, 0.3, 40, 0.0, 0, 0.0, 1, 0, 1), (40, 0.4, 20, 0.0, 2, 1.0, 1, 0, 1), (30, 0.4, 60, 0.0, 3, 1.0, 0, 0, 1),
    (12, 0.0, 3, 1.0, 50, 0.0, 0, 0, 1), (18, 0.0, 4, 1.0, 60, 0.0, 0, 0, 1), (20, 0.1, 2, 1.0, 30, 0.0, 0, 0, 1),
    # Lines such as a copyright or a share request that follow it.
    (6, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), (5, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0), (7, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0), (4, 0.0, 20, 0.0, 4, 1.0, 0, 0, 0),
)

# The same where an element with a furniture name holds the block: before the
# label how plainly it is named (1: by a part of a compound that may be about
# the text, 2: plainly) and the share of the page's words that it holds.
NAMED = (
    # Plain names: adverts, comments, notices, wherever they stand and whatever they say.
    (8, 0.0, 60, 0.0, 70, 0.0, 1, 0, 2, 0.03, 0), (40, 0.0, 60, 0.0, 0, 0.0, 1, 0, 2, 0.2, 0), (90, 0.0, 80, 0.0, 85, 0.0, 1, 0, 2, 0.4, 0), (3, 1.0, 50, 0.0, 4, 1.0, 1, 0, 2, 0.05, 0),
    (8, 0.0, 3, 1.0, 70, 0.0, 0, 0, 2, 0.03, 0), (40, 0.0, 60, 0.0, 20, 0.0, 0, 0, 2, 0.2, 0), (90, 0.0, 80, 0.0, 85, 0.0, 0, 0, 2, 0.6, 0), (2, 0.0, 0, 0.0, 60, 0.0, 0, 0, 2, 0.02, 0),
    (15, 0.1, 30, 0.0, 30, 0.0, 1, 0, 2, 0.9, 0), (60, 0.0, 0, 0.0, 40, 0.0, 0, 0, 2, 1.0, 0), (20, 0.0, 40, 0.0, 4, 1.0, 0, 0, 2, 0.1, 0), (5, 0.0, 40, 0.0, 50, 0.0, 1, 0, 2, 0.01, 0),
    # Compounds within a main element: a section about something, if it is text; links, if it is links.
    (60, 0.0, 50, 0.0, 40, 0.0, 1, 0, 1, 0.3, 1), (12, 0.0, 60, 0.0, 50, 0.0, 1, 0, 1, 0.1, 1), (3, 0.0, 60, 0.0, 40, 0.0, 1, 0, 1, 0.2, 1), (30, 0.2, 3, 0.0, 0, 0.0, 1, 0, 1, 0.1, 1),
    (8, 0.0, 0, 0.0, 20, 0.0, 1, 0, 1, 0.6, 1), (25, 0.0, 40, 0.0, 4, 1.0, 1, 0, 1, 0.4, 1), (5, 0.0, 12, 0.0, 9, 0.0, 1, 0, 1, 0.05, 1), (80, 0.1, 70, 0.0, 60, 0.0, 1, 0, 1, 0.9, 1),
    (2, 1.0, 60, 0.0, 3, 1.0, 1, 0, 1, 0.03, 0), (6, 0.9, 3, 1.0, 4, 1.0, 1, 0, 1, 0.1, 0), (12, 0.8, 40, 0.0, 0, 0.0, 1, 0, 1, 0.05, 0), (4, 1.0, 12, 0.0, 9, 0.0, 1, 0, 1, 0.4, 0),
    # Compounds outside: what surrounds the article.
    (8, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1, 0.04, 0), (40, 0.0, 60, 0.0, 30, 0.0, 0, 0, 1, 0.3, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 1, 0.1, 0), (25, 0.1, 50, 0.0, 0, 0.0, 0, 0, 1, 0.15, 0),
    (60, 0.0, 0, 0.0, 70, 0.0, 0, 0, 1, 1.0, 0), (90, 0.0, 40, 0.0, 80, 0.0, 0, 0, 1, 0.5, 0), (20, 0.0, 40, 0.0, 4, 1.0, 0, 0, 1, 0.1, 0), (5, 0.0, 40, 0.0, 70, 0.0, 0, 0, 1, 0.05, 0),
)

LABELLED = tuple((*row[:-1], 0, 0.0, row[-1]) for row in UNNAMED) + NAMED


def grown(rows: np.ndarray, depth: int = 9) -> tuple | float:
    """A decision tree, (feature, threshold, at most, above), with the share of label 1 at its leaves."""
    labels = rows[:, -1]
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return float(share)
    best = None
    for feature in range(rows.shape[1] - 1):
        values = np.unique(rows[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= threshold
            impurity = sum(part.sum() * (p := labels[part].mean()) * (1 - p) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, threshold, low
    if best is None:
        return float(share)
    _, feature, threshold, low = best
    return feature, float(threshold), grown(rows[low], depth - 1), grown(rows[~low], depth - 1)


def judged(tree: tuple | float, values: tuple) -> float:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if feature >= len(values) or values[feature] <= threshold else high  # unnamed where not told
    return tree


def furniture_name(value: str, main: int) -> tuple[int, bool]:
    """How plainly a class, id or role names furniture (0, 1, 2), and whether by words of layout only.

    The header of an article is none. A name that is also used for layout, or
    may be about the text, is plain only as the last part of its compound.
    """
    strength, layout = 0, True
    for name in value.lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if not parts or LAYOUT.intersection(parts):
            continue
        names = (FURNITURE_NAMES - {"header"} if main or parts[0] in OWN_PARTS else FURNITURE_NAMES).intersection(parts)
        if names:
            plain = parts[-1] in names or bool(names - AMBIGUOUS)
            strength, layout = max(strength, 1 + plain), layout and names <= STRUCTURAL
    return strength, layout


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, float]]:
    """(text, words, linked words, in a main element, in furniture, how plainly named furniture, its share) of each text block, in page order.

    A form is furniture, unless it holds most of the page's words, as one
    around the whole page does; nor is an element with most of them named by
    words that are also used for layout.
    """
    out: list[tuple] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple] = []  # open block elements: name, in main, in furniture, number of the outermost form, named elements around it
    linked = False
    forms = elements = 0

    def end() -> None:
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            words = len(text.split())
            links = len(html.unescape(" ".join(p for p, link in parts if link)).split())
            out.append((text, words, min(links, words), *(stack[-1][1:] if stack else (0, 0, 0, ()))))
        parts.clear()

    at = 0
    while True:
        found = MARKUP.search(page, at)
        if found is None:
            parts.append((page[at:], linked))
            break
        parts.append((page[at : found.start()], linked))
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        closing, rest = found["close"], found["rest"]
        if name in RAW:
            if name not in INLINE and name != "button":
                end()
            if not closing and not rest.endswith("/"):
                stop = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name in INLINE:
            if name == "a":
                linked = not closing
            elif name == "br":
                parts.append((" ", linked))
            continue
        end()
        linked = False
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name not in VOID and not rest.endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                stack.pop()
            main, furniture, form, around = stack[-1][1:] if stack else (0, 0, 0, ())
            values = [m[1] or m[2] or m[3] or "" for m in CLASSES.finditer(rest)]
            names = {w for value in values for w in re.split(r"[\s_-]+", value.lower())}
            if name in MAIN and not main and (name == "main" or furniture < 2):
                furniture = form = 0
                around = () if name == "main" else around
            if name in MAIN or "main" in names and not (furniture or form or around):
                main = 1
            if name == "form":
                forms += 1
                form = form or forms
            elif name in FURNITURE and not (name == "header" and (main or names & OWN_PARTS)):
                furniture = max(furniture, 1 if name in WRAPPERS else 2)
            if name not in ("html", "body", "form", *MAIN):
                strength, layout = max((furniture_name(value, main) for value in values), key=lambda x: (x[0], not x[1]), default=(0, True))
                if strength:
                    elements += 1
                    around = (*around, (elements, strength, layout, main))
            stack.append((name, main, furniture, form, around))
    end()
    total, held, inside = 0, Counter(), Counter()
    for _, words, _, _, _, form, around in out:
        total += words
        held[form] += words
        for element, *_ in around:
            inside[element] += words
    whole = {form for form, words in held.items() if 2 * words > total}
    found = []
    for text, words, links, main, furniture, form, around in out:
        named = [(strength, -inside[e] / total, within) for e, strength, layout, within in around if not (layout and 2 * inside[e] > total)]
        strength, share, _ = max(named, default=(0, 0.0, 1))
        # An article in something named furniture is not the page's.
        main = int(main and all(within for _, _, within in named))
        found.append((text, words, links, main, int(furniture > 0 or form > 0 and form not in whole), strength, -share))
    return found


def main_text(page: str | None, tree: tuple | float) -> str:
    """The blocks that the tree takes for the article, in page order, one to a line."""
    found = blocks(page or "")
    sides = [(0, 0.0), *((words, links / words) for _, words, links, *_ in found), (0, 0.0)]
    kept = []
    for i, (text, _, _, *holders) in enumerate(found):
        if judged(tree, (*sides[i + 1], *sides[i], *sides[i + 2], *holders)) >= 0.5:
            kept.append(text)
    return "\n".join(kept)


def extracted(page: Column) -> Column:
    """The main text of a column of html; empty for null and empty pages and pages without an article.

    A page is read whole, whatever its length. Markup that is never closed
    ends with its parent or the page; a comment or script that is never closed
    reaches to the end, as in a browser.
    """
    tree = grown(np.array(LABELLED, float))

    @pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(page, tree) for page in pages], dtype=object)

    return F.coalesce(of(page), F.lit(""))
