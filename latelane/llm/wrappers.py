"""Main text of web pages by wrappers inferred per host.

A page is read as a tree of block elements with text slots.  A wrapper is a union-free regular
expression over such trees: an element or slot, once, optional (?) or repeated (+).  Neighbours of
one kind become a repetition, and two trees are aligned node by node, where what only one of them
has becomes optional.  The wrappers of a host are aligned pairwise, in small groups, until one is
left; equal page shapes are reduced to one before, so a host with a third of all pages costs what
its shapes cost.

Every page is then matched against its host's wrapper: an element may pass over optional nodes and
take up a repetition again, and each block of text fills a slot.  Figures of the slots over all
pages of the host, and the optional marks, tell the host's own text from that of the article.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelane.llm.common import small
from latelane.session import materialise

#: Wrappers aligned in one task.
FAN_IN = 64
#: A slot with one text on this many different pages holds the host's text.
ENOUGH = 8
#: Elements nested deeper belong to their ancestor at this depth; their text is kept.
DEPTH = 100

_RAW = "script|style|noscript|template|svg|iframe|textarea|select|object|canvas"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike "
    "strong sub sup time tt u var wbr nobr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that starts closes these when one of them is open in the same list, table or block.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
_SCOPE = frozenset("ul ol dl table div article section main body html".split())
_CLOSE_P = ("p", "h1", "h2", "h3", "h4", "h5", "h6")

#: Elements and name parts of classes, ids and roles that are not the article.
_OTHER_ELEMENTS = frozenset("head nav footer aside form button dialog menu title".split())
_OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored cookie cookies consent "
    "gdpr notice notices alert popup modal overlay dialog menu nav navbar navigation breadcrumb breadcrumbs sidebar aside "
    "complementary footer contentinfo masthead comment comments disqus replies respond share sharing social related "
    "recommended subscribe newsletter signup login search widget pagination pager toolbar hidden".split()
)
# Words that say nothing of the content beside one of those names: ``share-bar`` is no article, ``search-algorithms`` may be.
_PLAIN_NAMES = frozenset(
    "area bar block blocks body bottom box button buttons center column container content footer form group head header icons "
    "inner item items left link links list main nav outer page panel post posts right row section site slot text top unit wrap "
    "wrapper articles stories topics".split()
)
_MAIN_NAMES = frozenset("article articlebody post entry story content".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOXES = frozenset("div section ins".split())


@lru_cache(maxsize=50_000)
def _label(name: str, attributes: str) -> str:
    """Element name with its class, id and role names; numbers in them are left out."""
    names = []
    for kind, *values in _ATTRIBUTE.findall(attributes):
        if kind.lower() == "hidden":
            names.append("hidden")
        elif kind.lower() in ("class", "id", "role", "itemprop"):
            value = re.sub(r"[^a-z _-]+", "", next((v for v in values if v), "").lower())
            names += [x for x in value.split() if x]
    return ".".join([name, *sorted(set(names))])


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """(path of elements, text, characters in links) of every block of text, and (path, '', 0) where an element ends.

    Text is decoded, its white space is single blanks.  Inline elements and line breaks do not end a block.
    """
    stack: list[str] = []
    deeper: list[str] = []  # names of open elements below ``DEPTH``
    raw: list[str] = []
    linked = in_link = 0

    def flush():
        nonlocal raw, linked
        text = " ".join(html.unescape("".join(raw)).split()) if raw else ""
        found = [(tuple(stack), text, min(linked, len(text)))] if text else []
        raw, linked = [], 0
        return found

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            raw.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
        if name in ("br", "img", "hr"):
            raw.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name in _INLINE or name in _VOID:
            continue
        elif closing and name in deeper:
            yield from flush()
            del deeper[len(deeper) - 1 - deeper[::-1].index(name) :]
            in_link = 0
        elif closing:
            yield from flush()
            open_names = [x.split(".", 1)[0] for x in stack]
            if name in open_names:
                deeper.clear()
                last = len(stack) - 1 - open_names[::-1].index(name)
                for _ in range(len(stack) - last):
                    yield tuple(stack), "", 0
                    stack.pop()
            in_link = 0
        else:
            yield from flush()
            in_link = 0
            if deeper:
                deeper.append(name)
                continue
            if stack and stack[-1].split(".", 1)[0] in _CLOSE_P:
                yield tuple(stack), "", 0
                stack.pop()
            ended = _ENDS.get(name, ())
            while ended and stack and stack[-1].split(".", 1)[0] in ended:
                yield tuple(stack), "", 0
                stack.pop()
            if len(stack) < DEPTH:
                stack.append(_label(name, attributes or ""))
            else:
                deeper.append(name)
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z!/][^>]*\Z", rest)  # a tag that the end of the page cuts off
        raw.append(rest[: cut.start()] if cut else rest)
    yield from flush()
    while stack:
        yield tuple(stack), "", 0
        stack.pop()


# --- wrappers -----------------------------------------------------------------------------
# A node is (label, children, optional, repeated); a slot has the label "#" and no children.


def _joined(a: tuple, b: tuple) -> tuple:
    """Two nodes of one label as one."""
    return a[0], align(a[1], b[1]), a[2] or b[2], a[3] or b[3]


def fold(nodes: list[tuple]) -> tuple:
    """Neighbours of one label, and neighbouring pairs and triples of labels, as repetitions."""
    out: list[tuple] = []
    for node in nodes:
        out.append(node)
        for width in (1, 2, 3):
            if len(out) >= 2 * width and [x[0] for x in out[-2 * width : -width]] == [x[0] for x in out[-width:]]:
                pairs = list(zip(out[-2 * width : -width], out[-width:]))
                out[-2 * width :] = [(*_joined(a, b)[:3], True) for a, b in pairs]
                break
    return tuple(out)


def align(a: tuple, b: tuple) -> tuple:
    """The union-free expression of two lists of nodes: shared nodes once, others optional."""
    if a == b:
        return a
    out: list[tuple] = []
    matcher = SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False)
    for kind, i, k, j, n in matcher.get_opcodes():
        if kind == "equal":
            out += [_joined(x, y) for x, y in zip(a[i:k], b[j:n])]
        else:
            out += [(x[0], x[1], True, x[3]) for x in (*a[i:k], *b[j:n])]
    return fold(out)


def shape(parts: list[tuple[tuple[str, ...], str, int]]) -> tuple:
    """The wrapper of one page."""
    levels: list[tuple[str, list]] = [("", [])]

    def close():
        label, children = levels.pop()
        levels[-1][1].append((label, fold(children), False, False))

    for path, text, _ in parts:
        shared = 0
        while shared < min(len(path), len(levels) - 1) and levels[shared + 1][0] == path[shared]:
            shared += 1
        while len(levels) - 1 > shared:
            close()
        for label in path[shared:]:
            levels.append((label, []))
        if text:
            levels[-1][1].append(("#", (), False, False))
        else:
            close()
    while len(levels) > 1:
        close()
    return fold(levels[0][1])


def expression(wrapper: tuple) -> str:
    """A wrapper in the usual notation: ``nav(ul((li(#))+)) article(h1(#) (p(#))+)``."""

    def one(node):
        text = node[0] + (f"({expression(node[1])})" if node[1] else "")
        return f"({text})" + ("*" if node[2] and node[3] else "?" if node[2] else "+") if node[2] or node[3] else text

    return " ".join(map(one, wrapper))


def _tuples(x):
    return tuple((label, _tuples(children), opt, rep) for label, children, opt, rep in x)


def dump(wrapper: tuple) -> str:
    return json.dumps(wrapper, separators=(",", ":"), ensure_ascii=False)


def load(text: str) -> tuple:
    return _tuples(json.loads(text))


class Template:
    """A wrapper made ready for matching: its nodes have numbers, 0 is the page."""

    def __init__(self, wrapper: tuple):
        self.label, self.chain, self.optional, self.repeated = [""], [()], [False], [False]
        self.below: list[list[int]] = [[]]
        self.places: list[dict[str, list[int]]] = [{}]
        self.needed: list[list[int]] = [[0]]  # of the first i children, how many are not optional
        self._add(0, wrapper)

    def _add(self, at: int, nodes: tuple) -> None:
        for label, children, optional, repeated in nodes:
            number = len(self.label)
            self.places[at].setdefault(label, []).append(len(self.below[at]))
            self.needed[at].append(self.needed[at][-1] + (not optional))
            self.below[at].append(number)
            self.label.append(label)
            self.chain.append((*self.chain[at], number) if label != "#" else self.chain[at])
            self.optional.append(optional)
            self.repeated.append(repeated)
            self.below.append([])
            self.places.append({})
            self.needed.append([0])
            self._add(number, children)

    def slots(self) -> dict[str, tuple]:
        """Key and chain of elements of every slot."""
        return {f"#{n}": self.chain[n] for n, label in enumerate(self.label) if label == "#"}

    def labels(self, chain: tuple) -> tuple[str, ...]:
        return tuple(self.label[x] if isinstance(x, int) else x for x in chain)

    def _take(self, level: list, label: str):
        """The node that the next child of an open element matches; its label where the wrapper has none."""
        at, last = level
        places = self.places[at].get(label) if isinstance(at, int) else None
        if not places:
            return label
        below = self.below[at]
        if last >= 0 and self.label[below[last]] == label and self.repeated[below[last]]:
            return below[last]
        i = bisect_right(places, last)
        ahead = places[i] if i < len(places) else None
        if ahead is None or self.needed[at][ahead] > self.needed[at][last + 1]:  # something needed would be passed over
            back = next((p for p in reversed(places[:i]) if self.repeated[below[p]]), None)
            ahead = back if back is not None else ahead if ahead is not None else places[i - 1]
        level[1] = ahead
        return below[ahead]

    def match(self, parts: list[tuple[tuple[str, ...], str, int]]) -> list[tuple[str, tuple]]:
        """Slot and chain of elements of every block of text.  What the wrapper lacks has its labels in the chain, and its own slot."""
        found, labels, levels = [], [], [[0, -1]]
        for path, text, _ in parts:
            shared = 0
            while shared < min(len(path), len(labels)) and labels[shared] == path[shared]:
                shared += 1
            del labels[shared:], levels[shared + 1 :]
            for label in path[shared:]:
                labels.append(label)
                levels.append([self._take(levels[-1], label), -1])
            if text:
                slot, chain = self._take(levels[-1], "#"), tuple(x for x, _ in levels[1:])
                found.append((f"#{slot}" if isinstance(slot, int) else "/".join(map(str, chain)), chain))
            else:
                labels.pop()
                levels.pop()
        return found


# --- which slots are the article -----------------------------------------------------------


@lru_cache(maxsize=50_000)
def _other(label: str) -> bool:
    name, *names = label.split(".")
    if name in _OTHER_ELEMENTS:
        return True
    if name in _HEADINGS:
        return False
    split = [{w for w in re.split(r"[-_]+", x) if w} for x in names]
    return any(words & _OTHER_NAMES and words <= _OTHER_NAMES | _PLAIN_NAMES for words in split)


def _main_at(path: tuple[str, ...], kind: str) -> int:
    """Where the article begins in a path, or -1."""
    for i, label in enumerate(path):
        name, *names = label.split(".")
        words = {w for x in names for w in re.split(r"[-_]+", x)}
        if kind == "article" and name == "article" or kind == "main" and (name == "main" or "main" in names):
            return i
        if kind == "named" and words & _MAIN_NAMES and name not in ("body", "html"):
            return i
    return -1


def article_slots(template: Template, taken: dict[str, tuple], figures: dict[str, tuple[int, int, int, bool]]) -> set[str]:
    """The slots of the article among those that a page has filled (``taken``: slot and chain of elements).

    ``figures`` has (different pages, characters, linked characters, constant) of each.  An ``article`` element, else
    ``main``, else a container named so, holds the article; boxes in it that are optional and have one text on
    ``ENOUGH`` pages are inserted notices or adverts.  Without any, it is the deepest element of the
    wrapper with most of the text that varies from page to page and is not links.  Page headers
    stand outside it; menus, adverts and the like are left out inside it too.
    """

    def constant(slot):
        pages, _, _, same = figures.get(slot, (0, 0, 0, False))
        return same and pages >= ENOUGH

    def inserted(slot, chain, at):
        boxes = (x for x in chain[at + 1 :] if isinstance(x, int) and template.optional[x] and not template.repeated[x])
        return constant(slot) and any(template.label[x].split(".", 1)[0] in _BOXES for x in boxes)

    paths = {slot: template.labels(chain) for slot, chain in taken.items()}
    open_slots = {slot: p for slot, p in paths.items() if not any(_other(x) for x in p)}
    for kind in ("article", "main", "named"):
        found = {slot: at for slot, p in open_slots.items()
                 if (at := _main_at(p, kind)) >= 0 and not any(x.split(".", 1)[0] == "header" for x in p[:at])}
        if found:
            return {slot for slot, at in found.items() if not inserted(slot, taken[slot], at)} or set(found)
    below_header = [s for s, p in open_slots.items() if not any(x.split(".", 1)[0] == "header" or "header" in x.split(".")[1:] for x in p)]
    weight: dict[str, int] = {}
    for strict in (True, False):  # where everything is constant or linked, that is no sign
        for slot in below_header:
            _, characters, linked, _ = figures.get(slot, (0, 0, 0, False))
            if not strict or not constant(slot) and 2 * linked < max(1, characters):
                weight[slot] = max(1, characters - linked)
        if weight:
            break
    base: tuple = ()
    while True:
        here = {slot: w for slot, w in weight.items() if taken[slot][: len(base)] == base}
        below: dict[tuple, int] = {}
        for slot, w in here.items():
            chain = taken[slot]
            if len(chain) > len(base) + 1:
                below[chain[: len(base) + 1]] = below.get(chain[: len(base) + 1], 0) + w
        best = max(below, key=lambda c: (below[c], tuple(map(str, c))), default=None)
        if best is None or below[best] < 0.6 * sum(here.values()):
            return set(here)
        base = best


# --- on tables -----------------------------------------------------------------------------

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_FIGURES = "array<struct<slot: string, pages: long, characters: long, linked: long, constant: boolean>>"


def _shapes(batches):
    for batch in batches:
        found = [dump(shape(list(blocks(page or "")))) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], names=["host", "tree"])


def _aligned(key: tuple, table: pa.Table) -> pa.Table:
    # Most pages first, so that the common shape leads and rare ones add options.
    rows = sorted(zip(table["pages"].to_pylist(), table["tree"].to_pylist()), key=lambda r: (-r[0], r[1]))
    wrapper = load(rows[0][1])
    for _, text in rows[1:]:
        wrapper = align(wrapper, load(text))
    return pa.table({"host": [key[0].as_py()], "tree": [dump(wrapper)], "pages": pa.array([sum(r[0] for r in rows)], pa.int64())})


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _remembered(known: dict, host: str, make):
    if host not in known:
        if len(known) > 256:
            known.clear()
        known[host] = make()
    return known[host]


def _figured(batches):
    """A row for each slot that a page fills: its characters, those in links, its text and all other text of the page as numbers."""
    known: dict[str, Template] = {}
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for host, tree, page in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "html"))):
            template = _remembered(known, host, lambda: Template(load(tree)))
            parts = list(blocks(page or ""))
            texts = [(text, linked) for _, text, linked in parts if text]
            own: dict[str, list] = {}
            for (slot, _), (text, linked) in zip(template.match(parts), texts):
                entry = own.setdefault(slot, [0, 0, []])
                entry[0] += len(text)
                entry[1] += linked
                entry[2].append(text)
            digests = {slot: _digest(slot + "\n".join(held)) for slot, (_, _, held) in own.items()}
            whole = sum(digests.values())
            for slot, (characters, linked, _) in own.items():
                rest = (whole - digests[slot] + 2**63) % 2**64 - 2**63
                for column, value in zip(out, (host, slot, characters, linked, digests[slot], rest)):
                    column.append(value)
        types = pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types)], names=["host", "slot", "characters", "linked", "text", "rest"]
        )


def _by_slot(figures) -> dict[str, tuple[int, int, int, bool]]:
    return {f["slot"]: (f["pages"], f["characters"], f["linked"], f["constant"]) for f in figures or ()}


def _chosen(batches):
    for batch in batches:
        found, texts = [], []
        for tree, figures in zip(batch.column("tree").to_pylist(), batch.column("figures").to_pylist()):
            wrapper = load(tree)
            template, known = Template(wrapper), _by_slot(figures)
            taken = template.slots()
            article = article_slots(template, taken, known)
            found.append(list(dict.fromkeys("/".join(template.labels(taken[slot])) for slot in taken if slot in article)))
            texts.append(expression(wrapper))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.string())), batch.column("figures")],
            names=["host", "wrapper", "article", "figures"],
        )


def _hosted(pages: DataFrame, url: str, page: str) -> DataFrame:
    """Pages with a host: ``host``, ``html``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), _HOST, 1))
    return pages.select(host.alias("host"), F.col(f"`{page}`").alias("html")).filter("host <> ''")


def _rules(pages: DataFrame) -> DataFrame:
    """Of every host: ``tree`` (its wrapper) and ``figures`` (of each slot: different pages, characters, linked characters, whether all
    pages have one text there).  Pages without a difference outside the slot count as one."""
    shapes = pages.mapInArrow(_shapes, "host string, tree string")
    wrappers = materialise(shapes.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("pages")), "wrappers")
    while True:
        per_host = wrappers.groupBy("host").agg(F.count(F.lit(1)).alias("shapes"))
        if not (per_host.agg(F.max("shapes")).first()[0] or 0) > 1:
            break
        placed = wrappers.join(per_host, "host").withColumn(
            "part", F.expr(f"pmod(xxhash64(tree), cast(ceil(shapes / {FAN_IN}) as bigint))")
        )
        wrappers = materialise(
            placed.groupBy("host", "part").applyInArrow(_aligned, "host string, tree string, pages long"), "wrappers"
        )
    wrappers = wrappers.select("host", "tree")
    filled = pages.join(small(wrappers), "host").mapInArrow(
        _figured, "host string, slot string, characters long, linked long, text long, rest long"
    )
    sums = F.sum("characters").alias("characters"), F.sum("linked").alias("linked")
    per_page = filled.groupBy("host", "slot", "rest").agg(*sums, F.min("text").alias("least"), F.max("text").alias("most"))
    figures = per_page.groupBy("host", "slot").agg(
        F.count(F.lit(1)).alias("pages"), *sums, (F.min("least") == F.max("most")).alias("constant")
    )
    # One list per host: as long as its wrapper has slots, which a task that matches holds anyway.
    per_host = figures.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "characters", "linked", "constant")).alias("figures"))
    return materialise(wrappers.join(per_host, "host", "left"), "wrapper_rules")


def infer(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One wrapper per host over all its pages: ``host``, ``wrapper`` (notation), ``article`` (paths of its slots), ``figures``."""
    return _rules(_hosted(pages, url, page)).mapInArrow(
        _chosen, f"host string, wrapper string, article array<string>, figures {_FIGURES}"
    )


def _filled(batches):
    known: dict[str, tuple] = {}
    for batch in batches:
        texts = []
        for host, tree, rule, page in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "figures", "html"))):
            parts = list(blocks(page or ""))
            if tree:
                template, of_host = _remembered(known, host, lambda: (Template(load(tree)), _by_slot(json.loads(rule or "[]"))))
            else:  # a page without a host is its own wrapper
                template, of_host = Template(shape(parts)), {}
            parts_filled = template.match(parts)
            taken = dict(parts_filled)
            figures: dict[str, tuple] = {}
            for (slot, _), (text, linked) in zip(parts_filled, [(t, n) for _, t, n in parts if t]):
                _, characters, links, _ = figures.get(slot, (1, 0, 0, False))
                figures[slot] = 1, characters + len(text), links + linked, False
            figures |= {slot: of_host[slot] for slot in figures if slot in of_host}
            article = article_slots(template, taken, figures)
            held = [text for _, text, _ in parts if text]
            texts.append("\n".join(text for (slot, _), text in zip(parts_filled, held) if slot in article))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["k", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """The article of every page: ``key``, ``url``, ``text`` (blocks joined by line feeds), ``n_chars`` (code points).

    A null or empty page has an empty text.  Pages without a host in their url, null urls among them, have nothing in common
    and are judged each by itself, by its own wrapper.  Repeated rows and null
    keys are pages like others; an empty table gives no rows; other columns are not read.  Unclosed,
    cut-off and very deep markup is read as far as it goes and loses no text of the article.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html"))
    rules = _rules(_hosted(pages, url, page)).select("host", "tree", F.to_json("figures").alias("figures"))
    joined = rows.withColumn("host", host).join(small(rules), "host", "left")
    filled = joined.select("k", "url", "html", "host", "tree", "figures").mapInArrow(
        _filled, "k long, url string, text string, n_chars long"
    )
    return filled.withColumnRenamed("k", key)
