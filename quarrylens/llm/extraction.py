"""Main text of web pages by line-block distribution.

1.  Markup is stripped into lines: one for each block of the page, in page order.  What is
    never main text (scripts, styles, forms, menus, page headers and footers, sidebars, notices,
    adverts, reader comments, told by element, role, class or id) is left out, and outside
    articles leaves blank lines.  Two kinds of boxes are told by what is in them: menus are boxes
    of three or more links and no other text; reader comments are repeated boxes of one class, each
    with a link or a time, beside a form, in less than half of the page's text.
2.  A line weighs as much as its text, decoded and trimmed, without links (but a linked heading of
    an article weighs), so that lists of links don't weigh.  What else is known about it is a
    factor: lines of ``article`` and ``main`` weigh PRIOR times as much, and so do the regions
    beside a surge in the same element; a loose line after the last article, in no element, weighs
    nothing.  Of several ``article`` elements those that don't surge are teasers, and have no
    factor, if text outside surges.
3.  The distribution is the sum of weights over a sliding window of lines.  Blank lines as wide
    as the window bring it to zero, so that it falls into regions.
4.  The surge point of a region is the first line of the first window whose sum reaches the
    threshold, the dive point the last line of the last one.  The text of every page is what lies
    between them, region by region.  On a page where nothing surges, the threshold is the highest
    sum there is.

Defined results
    null or empty html     empty text, n_chars 0
    unclosed elements      end with the element around them, or at the end of the page
    unclosed quotes        the tag ends at the next >
    very long html         read whole by one task, with attribute values of any length
    repeated rows, ties    each row is extracted on its own
    null page_id or url    kept, like any other value
    empty table            no rows
    other columns          ignored
"""

from __future__ import annotations

import html as references
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60
PRIOR = 20  # factor of lines that an article, or an element with a surge, holds

# Element names by what they mean for a page's text.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
    main menu nav noscript ol optgroup option p pre search section select summary table tbody td
    tfoot th thead title tr ul video audio""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "template", "noscript", "iframe", "svg", "object", "canvas")
NOISE = frozenset("head nav aside footer form menu dialog select button search label fieldset audio video".split())
ARTICLE = frozenset(("article", "main"))
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion
    banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr
    notice notices notification alert popup modal overlay newsletter subscribe subscription signup
    login share sharing social related recommended comment comments respond disqus discussion
    pagination pager widget toolbar skip masthead topbar copyright disclaimer""".split()
)
NOISE_STARTS = ("advert", "breadcrumb", "commentlist", "cookie", "newsletter", "sidebar", "sponsor")
NOISE_NAMES = frozenset("header footer site-header site-footer page-header page-footer".split())
# After a noise word these only name a box of it; beside one, the others say that it's about the rest.
NOISE_BOXES = frozenset(
    """area bar block bottom box btn button buttons by col column container content form header footer icons inner item
    items left line link links list panel posts right section slot small stories text title top unit""".split()
)
WRAPPERS = frozenset("has with no without wrap wrapper layout".split())
HARD, SOFT = 2, 1  # noise by what an element is; noise by its name only
LISTS = frozenset("div section ul ol dl table tr p".split())  # boxes that may be menus
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("div section article main body td center".split())
# An end tag of one of these ends whatever is still open inside.
OUTER = frozenset("article main body html section div nav aside footer header form ul ol table".split())

# The inside of a tag: quoted values end before a space, / or >; if quotes don't, the next > ends it.
_INSIDE = r"""(?:(?>(?:[^>"']|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))*)(?=>)|[^>]*)"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b" + _INSIDE + r"(?:>|$).*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>" + _INSIDE + r")(?:>|$)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_CLASS = re.compile(r"""(?<![\w-])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)


class _Box:
    """What an open element holds so far, itself and in the elements that are closed in it."""

    __slots__ = ("name", "number", "likeness", "before", "links", "marks", "forms", "alike", "items")

    def __init__(self, name: str, number: int, rest: str, before: int):
        found = _CLASS.search(rest) if rest else None
        of_class = " ".join((found[1] or found[2] or found[3] or "").split()) if found else ""
        self.name, self.number, self.before = name, number, before
        self.likeness = (name, of_class) if of_class or name in ("li", "article") else None
        self.links = self.marks = self.forms = 0
        self.alike: dict = {}  # children by likeness: how many, and how many with text and a link or a time
        self.items: list[tuple[int, int]] = []  # elements of repeated boxes: number, weight

    def closed(self, weight: int, parent: _Box, menus: set[int], candidates: list) -> None:
        own = weight - self.before
        if self.name in LISTS and self.links >= 3 and own <= self.links:
            menus.add(self.number)
        if any(n >= 2 and n == signed for n, signed in self.alike.values()):
            self.items.append((self.number, own))
        if self.items and self.forms:
            inner = [x for x in self.items if x[0] != self.number]
            candidates.append((self.name, self.number, own, inner))
        parent.links += self.links
        parent.marks += self.marks
        parent.forms += self.forms
        parent.items += self.items
        if self.likeness:
            n, signed = parent.alike.get(self.likeness, (0, 0))
            parent.alike[self.likeness] = (n + 1, signed + (self.marks > 0 and own > 0))


def comment_boxes(candidates: list, total: int) -> set[int]:
    """Elements of repeated boxes with a form, in less than half of the page's weight; if they
    hold more, the repeated boxes in them that don't."""
    out: set[int] = set()
    for name, number, own, inner in candidates:
        if name not in ("article", "main", "body", "html") and 2 * own < total:
            out.add(number)
        else:
            out.update(n for n, weight in inner if 2 * weight < total)
    return out


def is_noise_name(token: str) -> bool:
    """Whether a class or id names noise: a noise word, then at most words for a box of it."""
    if token in NOISE_NAMES or token in NOISE_WORDS:
        return True
    parts = [x for x in re.split(r"[-_]+", token) if x]
    if not WRAPPERS.isdisjoint(parts):
        return False
    words = [x in NOISE_WORDS or x.startswith(NOISE_STARTS) for x in parts]
    return any(words) and all(word or x in NOISE_BOXES or x.isdigit() for x, word in list(zip(parts, words))[words.index(True) :])


def is_noise(name: str, rest: str, in_article: bool) -> int:
    """Whether an element holds nothing of the main text, by its name and attributes (HARD),
    or by its class or id (SOFT); else 0."""
    if name in NOISE or (name == "header" and not in_article):
        return HARD
    if not rest or name in ("html", "body", "main"):
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return HARD
        if key == "role" and value in NOISE_ROLES:
            return HARD
        if key == "style" and "display:none" in value.replace(" ", ""):
            return HARD
        if key in ("class", "id"):
            for token in value.split():  # an article: a comment or an advert; not one about them
                if token in NOISE_WORDS if name == "article" else is_noise_name(token):
                    found = SOFT
    return found


def page_lines(html: str, window: int = WINDOW, surge: int = SURGE) -> tuple[list[str], list[int], list[int], list[int]]:
    """Lines of a page, their weights (lengths without links), the article they are in
    (the number of the outermost, negative for main, or 0), and the numbers of the elements
    that hold them.

    An element that is noise by its class or id alone is spared, and the page read again, if it
    holds ``main``, or most of the weight of a page where nothing surges without it or every
    article is inside.  Boxes that are noise by what they hold are left out when it is read again.
    """
    *out, named, menus, candidates = _page_lines(html, window, frozenset(), frozenset())
    lines, weights, anchored, _ = out
    spared: set[int] = set()
    if named:
        total = sum(weights) + named.pop("weight")
        alone = not any(x > 0 for x in anchored)
        calm = not any(anchored) and max(distribution(weights, window), default=0) < surge
        spared = {k for k, (weight, articles, mains) in named.items() if mains or (2 * weight > total and weight >= surge and (calm or (articles and alone)))}
    boxes = (menus if any(weights) else set()) | comment_boxes(candidates, sum(weights))
    if spared:  # what they hold counts
        *out, _, menus, candidates = _page_lines(html, window, frozenset(spared), frozenset())
        boxes = (menus if any(out[1]) else set()) | comment_boxes(candidates, sum(out[1]))
    if boxes:
        *out, _, _, _ = _page_lines(html, window, frozenset(spared), frozenset(boxes))
    return tuple(out)


def _page_lines(html: str, window: int, spared: frozenset[int], boxes: frozenset[int]) -> tuple[list[str], list[int], list[int], list[int], dict, set, list]:
    """The lines of a page; by number, the weight, articles and mains in each element that is
    noise by its class or id (their weight together at "weight"); menus; candidates for comments."""
    lines, weights, anchored, holders = [], [], [], []
    parts: list[str] = []
    unlinked: list[str] = []  # those outside links
    stack: list[tuple[str, int, int]] = []  # open elements: name, the kind of noise that begins there, number
    root = _Box("html", 0, "", 0)
    open_boxes = [root]  # one for each element of the stack, after the page's
    menus: set[int] = set()
    candidates: list = []
    weighed = 0
    named: dict = {}
    inside = [0, 0, 0]  # weight, articles and mains so far in noise that isn't hard
    hard = 0
    noise = article = owner = link = at = 0

    def flush() -> None:
        nonlocal weighed
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            lines.append(text)
            whole = len(unlinked) == len(parts) or (article > 0 and any(x[0] in HEADINGS for x in stack[-2:]))
            weights.append(len(text) if whole else len(" ".join(references.unescape(" ".join(unlinked)).split())))
            weighed += weights[-1]
            anchored.append(owner if article > 0 else 0)
            holders.append(next((n for name, _, n in reversed(stack) if name in HOLDERS), 0))
        parts.clear()
        unlinked.clear()

    def blank() -> None:
        lines.extend([""] * window)
        weights.extend([0] * window)
        anchored.extend([0] * window)
        holders.extend([0] * window)

    def add(text: str) -> None:
        if noise and not hard and not link:
            inside[0] += len(text.strip())
        if text and not noise:
            parts.append(text)
            if not link:
                unlinked.append(text)

    def close(k: int) -> None:
        """Closes the elements of the stack from k on."""
        nonlocal noise, hard, article
        for name, noisy, n in stack[k:]:
            noise -= noisy > 0
            hard -= noisy == HARD
            article -= name in ARTICLE
            if n in named:
                named[n] = [now - then for now, then in zip(inside, named[n])]
        while len(open_boxes) > k + 1:
            box = open_boxes.pop()
            if not stack[len(open_boxes) - 1][1]:
                box.closed(weighed, open_boxes[-1], menus, candidates)
        del stack[k:]

    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        if not m["name"]:
            if m["raw"]:
                add(" ")
                open_boxes[-1].forms += m["raw"].lower() == "textarea"
            continue
        name = m["name"].lower()
        if not m["end"] and not noise:
            open_boxes[-1].links += name == "a"
            open_boxes[-1].marks += name in ("a", "time")
            open_boxes[-1].forms += name in ("form", "button")
        if name == "br":
            add(" ")
        if name == "a":
            link = 0 if m["end"] else 1
            continue
        if name not in BLOCKS and not noise and not (m["end"] == "" and name not in VOID and is_noise(name, m["rest"], article > 0)) and not any(x[0] == name for x in stack[-3:]):
            continue  # inline
        if name in BLOCKS and not noise:
            flush()
        if name in VOID:
            continue
        if not m["end"]:
            if m["rest"].endswith("/") and name not in BLOCKS:
                continue
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                close(len(stack) - 1)  # its end tag may be left out
            noisy = HARD if m.start() + 1 in boxes else is_noise(name, m["rest"], article > 0)
            if noisy == SOFT and m.start() + 1 in spared:
                noisy = 0
            if noise and not hard and not noisy and name in ARTICLE:
                inside[1 if name == "article" else 2] += 1
            if noisy == SOFT and not hard:
                named[m.start() + 1] = list(inside)
            if noisy and not noise:
                flush()
                if not article:
                    blank()
            if name in ARTICLE and not noise:
                blank()
            stack.append((name, noisy, m.start() + 1))
            open_boxes.append(_Box(name, m.start() + 1, m["rest"], weighed))
            noise += noisy > 0
            hard += noisy == HARD
            if name in ARTICLE and not article:
                owner = m.start() + 1 if name == "article" else -m.start() - 1
            article += name in ARTICLE
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in ARTICLE and not noise:
                        blank()
                    close(k)
                    break
                if stack[k][0] in OUTER and name not in OUTER:
                    break  # a stray end tag
    add(html[at:])
    flush()
    close(0)
    if root.items and root.forms:
        candidates.append(("html", 0, weighed, root.items))
    if named:
        named["weight"] = inside[0]
    return lines, weights, anchored, holders, named, menus, candidates


def distribution(weights: list[int], window: int = WINDOW) -> list[int]:
    """Sums of weights over windows that end at each line."""
    total, out = 0, []
    for k, x in enumerate(weights):
        total += x - (weights[k - window] if k >= window else 0)
        out.append(total)
    return out


def weighted(lines: list[str], weights: list[int], anchored: list[int], holders: list[int], window: int, surge: int, prior: int) -> list[int]:
    """The weights of lines times the factors of what holds them."""
    sums = distribution(weights, window)
    regions = regions_of(lines)
    peaks = [max(sums[k] for k in run) for run in regions]
    owners = [next((anchored[k] for k in run if anchored[k]), 0) for run in regions]
    last = max((n for n, owner in enumerate(owners) if owner), default=None)
    least = min(surge, max(peaks, default=0)) if last is None else surge
    loose = [last is not None and n > last and len(run) == 1 and not holders[run[0]] for n, run in enumerate(regions)]
    outside = [peak >= least and not owner and not alone for peak, owner, alone in zip(peaks, owners, loose)]
    near = {holders[k] for run, surges in zip(regions, outside) if surges for k in run}
    full = {owner for owner, peak in zip(owners, peaks) if peak >= surge}
    cards = {owner for owner in owners if owner > 0}
    teasers = cards - full if len(cards) > 1 and any(outside) else set()
    out = list(weights)
    for run, owner, alone, surges in zip(regions, owners, loose, outside):
        for k in run:
            if alone:
                out[k] = 0
            elif (owner and owner not in teasers) or (not owner and not surges and holders[k] in near):
                out[k] *= prior
    return out


def regions_of(lines: list[str]) -> list[list[int]]:
    return [list(run) for full, run in itertools.groupby(range(len(lines)), key=lambda k: bool(lines[k])) if full]


def between(run: list[int], sums: list[int], window: int, least: int) -> list[int]:
    """The lines of a region from its surge point to its dive point."""
    surging = [n for n, k in enumerate(run) if sums[k] >= least]  # windows that end there
    return run[max(surging[0] - window + 1, 0) : surging[-1] + 1] if surging else []


def main_text(html: str, window: int = WINDOW, surge: int = SURGE, prior: int = PRIOR) -> str:
    """The main text of a page: what lies between the surge and the dive points of its distribution."""
    if not html:
        return ""
    lines, *known = page_lines(html, window, surge)
    sums = distribution(weighted(lines, *known, window, surge, prior), window)
    least = max(min(surge, max(sums, default=0)), 1)
    kept = [between(run, sums, window, least) for run in regions_of(lines)]
    if not any(kept) and not any(known[0]) and not any(known[1]):
        kept = regions_of(lines)  # links only
    return "\n".join(lines[k] for run in kept for k in run)


def extracted(pages: DataFrame, window: int = WINDOW, surge: int = SURGE, prior: int = PRIOR) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, window, surge, prior) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
