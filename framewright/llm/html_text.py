"""Main text of web pages by wrappers inferred for each host.

A page becomes a tree of block tags with its texts as leaves; inline tags join
their text.  Within a page, runs of like siblings (and runs of up to three
siblings that recur together) fold into repeated groups.  The folded token
streams of a host's pages are aligned one after the other: tokens that both
sides have are merged, those of one side become optional, texts become slots.
The result is the host's wrapper, a union-free regular expression over tags.

The rows come out of the wrapper.  Each distinct folded stream is matched against
its host's wrapper, which names the slot of every text.  Slots are counted over
all pages: a slot varies if two pages differ there.  The content region is looked for in
three steps.  An ``article`` that occurs once a page and holds text on most of the host's pages is the region, or
else a ``main``; of several, the one with the most text in varying slots that aren't links.  Without them a part
whose class, id or role calls it main text is.  Without either the wrapper is walked down from its
root: into the one part that holds most of the characters of varying slots that aren't links, among the parts
that have a heading with text below it if there are any, as long as that part is a container that occurs
once and no heading, paragraph or list would stay behind.  Of equal parts the first one counts.
The text of a page is what the match puts into the region.  In a region found by walking, slots at its rim that never vary (on three pages at least) or consist
of links are template and go too.  A page whose match puts no text into the region
gives all its text but template.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments that
stand within the region are left out as the last step, by tag, role, class or id; scripts,
styles, templates and text fields hold no text.  Nothing else is dropped.

Only distinct folded streams of a host meet, in groups of about ``GROUP_OF``, whose wrappers meet in groups again
until the host has one: a host with a third of all pages is dealt to many tasks, and no task
gets more with more pages.  A node with over ``MOST_CHILDREN`` different children becomes a repeated group of
optional ones, ``(a?b?c?)*``, so a wrapper doesn't grow with the number of its pages.

Character references are decoded, white space in a block becomes one space, and
blocks are joined by one space in page order.  Null or empty html gives an empty
text; a null url is a host of its own name, the empty one.  Very long pages are read whole.
Broken markup is read as browsers do, roughly: an end tag closes what it
finds open, a block closes an open paragraph.  A page is judged by itself and its
host's wrapper; repeated rows give repeated results, an empty table an empty one.
Columns other than the three named ones are not read; their names may be any.
"""

from __future__ import annotations

import html
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import drop_table, small_batches, write_table
from framewright.llm.url_filters import host_and_path

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# Tags without content, tags whose content is no markup, tags inside a line, and tags that a like one closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark math noscript object q rp rt ruby s samp select small span strike strong sub sup svg time tt u var video wbr".split())
# Tags whose own tags close no paragraph and of which a self-closing one is closed, and tags that end them if they are still open.
FOREIGN = frozenset(("svg", "math", "select"))
FOREIGN_OPEN = re.compile(r"<(?:svg|math|select)[\s/>]", re.I)
BREAKOUT = frozenset("address article aside blockquote body center div dl dd dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "tbody": "table", "thead": "table"}

# What is left out inside a region: by tag, by role, and by a class or id all of whose words are marks or say nothing.
LEFT_OUT = frozenset("nav header footer aside form button select dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside widget cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion share sharing social related recommended comment comments disqus respond reply replies login signup pagination pager toolbar skip".split())
PLAIN_WORDS = frozenset("area article author bar block blog body bottom box button buttons container content count customer entry fixed floating form global group holder icons inner item items latest left link links list main meta mobile outer page panel post posts primary reader readers recent right row secondary section site slot sticky story text thread title top unit user users visitor visitors wrap wrapper".split())
# What an article may be called that is a reader's comment, and the words of classes and ids that call a part main text.
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
MAIN_WORDS, BESIDE_MAIN = frozenset("main article content post entry story".split()), frozenset("body text page inner wrap wrapper container area section single".split())
REGIONS = ("article", "main")
# Tags that only hold blocks: the walk to the region goes down through these.
CONTAINERS = frozenset("body article main section div center table tbody tr td".split())
HEADINGS = ("h1", "h2")
SLOT, MARKED, MAIN, GROUP, BAG = "#", "!", "@", "(", "["
#: Siblings that may recur together, and open tags below which blocks aren't told apart any more (their text stays).
LONGEST_GROUP, DEEPEST = 3, 100
#: Streams or wrappers that are aligned in one group, and children of a node before they become a repeated group of optional ones.
GROUP_OF, MOST_CHILDREN = 32, 64
#: Pages on which a slot must be the same to count as template.
CONSTANT_PAGES = 3


def words_of(name: str) -> set[str]:
    """The words of a class or id: split at signs and in camel case; a mark glued to a plain word gives both."""
    found = set()
    for word in map(str.lower, WORD.findall(name)):
        cut = next((k for k in range(2, len(word) - 1) if word not in MARKS and {word[:k], word[k:]} & MARKS and {word[:k], word[k:]} <= MARKS | PLAIN_WORDS), None)
        found |= {word[:cut], word[cut:]} if cut else {word}
    return found


def left_out(tag: str, attributes: str, in_region: bool) -> bool:
    if tag in LEFT_OUT:
        return not (tag == "header" and in_region)
    if not attributes or tag in ("html", "body", "main"):
        return False
    marks = COMMENTS if tag == "article" else MARKS
    for name, a, b, c in NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in ROLES and tag != "article":
            return True
        if name in ("class", "id"):
            for part in value.split():
                found = words_of(part)
                if found & marks and found <= MARKS | PLAIN_WORDS:
                    return True
    return False


def called_main(tag: str, attributes: str) -> bool:
    """Whether a part's role, class or id calls it the main text."""
    if tag not in CONTAINERS or tag in ("body", *REGIONS):
        return False
    for name, a, b, c in NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in REGIONS:
            return True
        if name in ("class", "id") and any((found := words_of(part)) & MAIN_WORDS and found <= MAIN_WORDS | BESIDE_MAIN for part in value.split()):
            return True
    return False


def symbol(tag: str, attributes: str, marked: bool) -> str:
    """A token of the wrapper: the tag with its first class or id without digits, and a mark if it is to be left out or called main text."""
    name = ""
    for kind, a, b, c in NAMED.findall(attributes) if attributes else ():
        if kind.lower() in ("class", "id"):
            name = next((x for x in (a or b or c).lower().split() if x.isascii() and x.replace("-", "_").isidentifier() and not any(map(str.isdigit, x))), "")
            if name:
                break
    return (MARKED if marked else MAIN if called_main(tag, attributes) else "") + tag + (f".{name}" if name else "")


# --- pages as trees: a node is [symbol, how, children, texts]; how: "" once, "?" optional, "+" repeated, "*" both


def parse(page: str) -> tuple[list, list[list]]:
    """The tree of the page's block tags, and its texts as [parts, characters in links]; leaves name their texts."""
    root: list = ["", "", [], []]
    texts: list[list] = []
    stack: list[tuple[str, list, bool, int]] = []  # tag, node, in a region, open links
    node, leaf, region, links = root, None, False, 0
    at, end = 0, len(page)
    foreign_page = FOREIGN_OPEN.search(page) is not None
    top = lambda: stack[-1][1:] if stack else (root, False, 0)
    while at < end:
        m = TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            text = page[at:start]
            if leaf is None and not text.isspace():
                leaf = [[], 0]
                node[2].append([SLOT, "", [], [len(texts)]])
                texts.append(leaf)
            if leaf is not None:
                leaf[0].append(html.unescape(text))
                leaf[1] += len(text) if links else 0
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        inside = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in FOREIGN), -1) if foreign_page else -1
        if inside >= 0 and tag in BREAKOUT and not (m[1] or m[4]):
            del stack[inside:]
            node, region, links = top()
            inside = -1
        inline = tag in INLINE or inside >= 0 and stack[inside][0] == "math" and tag not in BREAKOUT
        if not inline:
            leaf = None
        if m[1] or m[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            before = node
            node, region, links = top()
            leaf = leaf if node is before else None
            continue
        attributes = m[3] or m[6] or ""
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if attributes.endswith("/") and (tag not in INLINE or tag in FOREIGN or inside >= 0):
            continue
        if not inline and inside < 0:
            within = SELF_CLOSING.get(tag)
            for i in range(len(stack) - 1, -1, -1):
                open_tag = stack[i][0]
                if open_tag == "p" or within and open_tag == tag:
                    del stack[i:]
                    break
                if within and open_tag in within.split(" ") or not within and open_tag not in INLINE:
                    break
            node, region, links = top()
        region = region or tag in REGIONS
        marked = left_out(tag, attributes, region)
        links += tag == "a"
        if (not inline or marked) and tag != "html" and (len(stack) < DEEPEST or marked and node[0][:1] != MARKED):
            new = [symbol(tag, attributes, marked), "", [], []]
            node[2].append(new)
            node, leaf = new, None
        stack.append((tag, node, region, links))
    return root, texts


def squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _how(a: str, b: str = "", optional: bool = False, repeated: bool = False) -> str:
    both = a + b
    optional = optional or "?" in both or "*" in both
    if repeated or "+" in both or "*" in both:
        return "*" if optional else "+"
    return "?" if optional else ""


def _names(nodes: list) -> list[str]:
    return [x[0] for x in nodes]


def fold(node: list) -> list:
    """The node with runs of like siblings, and of siblings that recur together, as one repeated node or group."""
    nodes = [fold(x) for x in node[2]]
    for size in range(1, LONGEST_GROUP + 1):
        out: list = []
        for x in nodes:
            out.append(x)
            new = out[-size:]
            if size == 1:
                if len(out) > 1 and out[-2][0] == x[0]:
                    out[-2:] = [merge(out[-2], x, repeated=True)]
                continue
            group = GROUP + " ".join(_names(new)) + ")"
            if len(out) > size and out[-size - 1][0] == group:
                out[-size - 1 :] = [merge(out[-size - 1], [group, "", new, []], repeated=True)]
            elif len(out) >= 2 * size and _names(out[-2 * size : -size]) == _names(new):
                out[-2 * size :] = [merge([group, "", out[-2 * size : -size], []], [group, "", new, []], repeated=True)]
        nodes = out
    return [node[0], node[1], nodes, node[3]]


def _grouped(nodes: list, like: list) -> list:
    """The nodes, with siblings that are a group on the other side made one here too."""
    for g in {x[0]: x for x in like if x[0][:1] == GROUP}.values():
        names, out = _names(g[2]), []
        for x in nodes:
            out.append(x)
            if len(out) >= len(names) and _names(out[-len(names) :]) == names:
                out[-len(names) :] = [[g[0], "", out[-len(names) :], []]]
        nodes = out
    return nodes


def align(x: list, y: list) -> list[tuple[int | None, int | None]]:
    """Positions of like tokens in common order, and those of one side alone between them."""
    first, last = 0, 0
    while first < min(len(x), len(y)) and x[first][0] == y[first][0]:
        first += 1
    while last < min(len(x), len(y)) - first and x[-1 - last][0] == y[-1 - last][0]:
        last += 1
    a, b = x[first : len(x) - last], y[first : len(y) - last]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list = [(i, i) for i in range(first)]
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append((first + i, first + j))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append((first + i, None))
            i += 1
        else:
            out.append((None, first + j))
            j += 1
    return out + [(len(x) - k, len(y) - k) for k in range(last, 0, -1)]


def bag(nodes: list) -> list:
    """A repeated group of optional nodes, each symbol once, for a sequence of nodes."""
    if len(nodes) == 1 and nodes[0][0] == BAG:
        return nodes[0]
    kinds: dict[str, list] = {}
    for x in _members(nodes):
        kinds[x[0]] = merge(kinds[x[0]], x, repeated=True) if x[0] in kinds else x
    return [BAG, "*", [[x[0], _how(x[1], optional=True), x[2], x[3]] for _, x in sorted(kinds.items())], []]


def bagged(node: list) -> list:
    """The node with its children, where they are too many, as such a group; so in every node below it."""
    children = [bagged(x) for x in node[2]]
    if node[0] != BAG and (len(children) > MOST_CHILDREN or len(children) > 1 and any(x[0] == BAG for x in children)):
        children = [bag(children)]
    return [node[0], node[1], children, node[3]]


def _members(nodes: list):
    """The nodes with those of groups in their place."""
    for x in nodes:
        if x[0] == BAG or x[0][:1] == GROUP:
            yield from _members(x[2])
        else:
            yield x


def _in_bag(node: list) -> bool:
    return len(node[2]) == 1 and node[2][0][0] == BAG


def merge(a: list, b: list, repeated: bool = False) -> list:
    """One node for two of the same symbol: like tokens merge, the others become optional."""
    how, texts = _how(a[1], b[1], repeated=repeated), a[3] + b[3]
    if _in_bag(a) or _in_bag(b):
        kinds = {x[0]: x for x in bag(a[2])[2]}
        for x in bag(b[2])[2]:
            kinds[x[0]] = merge(kinds[x[0]], x) if x[0] in kinds else x
        return [a[0], how, [[BAG, "*", [x for _, x in sorted(kinds.items())], []]], texts]
    if _names(a[2]) == _names(b[2]):
        return [a[0], how, [merge(p, q) for p, q in zip(a[2], b[2])], texts]
    x, y = _grouped(a[2], b[2]), _grouped(b[2], a[2])
    children = []
    for i, j in align(x, y):
        if i is not None and j is not None:
            children.append(merge(x[i], y[j]))
        else:
            one = y[j] if i is None else x[i]
            children.append([one[0], _how(one[1], optional=True), one[2], one[3]])
    return [a[0], how, children, texts]


def bare(node: list) -> list:
    """The node without its texts: the shape of a page or host."""
    return [node[0], node[1], [bare(x) for x in node[2]], []]


def leaves(node: list):
    if node[0] == SLOT:
        yield node
    for x in node[2]:
        yield from leaves(x)


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression over tags and slots."""
    inner = "".join(expression(x) for x in node[2])
    text = SLOT if node[0] == SLOT else inner if node[0][:1] in ("", GROUP, BAG) else f"<{node[0]}>{inner}</{node[0]}>"
    return f"({text}){node[1]}" if node[1] else text


def match(shape: list, wrapper: list) -> list[tuple[str, bool]]:
    """For each leaf of the shape the slot of the wrapper, and whether it stands in something marked.

    Slots are named by the places of the nodes on the way; a node that the alignment leaves over stays at its parent's place.
    """
    out: list[tuple[str, bool]] = []

    def walk(node: list, to: list | None, place: str, marked: bool) -> None:
        marked = marked or node[0][:1] == MARKED
        if node[0] == SLOT:
            out.append((place, marked))
            return
        if to is not None and _in_bag(to):
            members = {x[0]: k for k, x in enumerate(to[2][0][2])}
            for x in _members(node[2]):
                k = members.get(x[0])
                walk(x, None if k is None else to[2][0][2][k], place if k is None else f"{place}.0.{k}", marked)
            return
        children = node[2] if to is None else _grouped(node[2], to[2])
        known = {} if to is None else {i: j for i, j in align(children, to[2]) if i is not None and j is not None}
        for i, x in enumerate(children):
            j = known.get(i)
            walk(x, None if j is None else to[2][j], place if j is None else f"{place}.{j}", marked)

    walk(shape, wrapper, "", False)
    return out


def tag_of(node: list) -> str:
    return node[0].lstrip(MARKED + MAIN).split(".")[0]


def content(wrapper: list, slots: dict[str, dict], pages: int) -> tuple[str, list[str]]:
    """The place of the content region in the wrapper, and the slots that are template.

    ``slots``: for each place the numbers of pages, characters, characters in links, whether it varies and is marked.
    ``pages``: how many pages the host has.
    """
    text = {p: s for p, s in slots.items() if not s["marked"] and 2 * s["links"] <= s["chars"]}
    text = {p: s for p, s in text.items() if s["varies"]} or text
    under = lambda place: [p for p in text if p == place or p.startswith(f"{place}.")]
    mass = lambda place: sum(text[p]["chars"] for p in under(place))
    found: dict[str, list[str]] = {"article": [], "main": [], MAIN: []}

    def seek(node: list, place: str) -> None:
        """Notes parts that a tag or name calls main text, that occur once and that most pages have text in."""
        for j, x in enumerate(node[2]):
            if x[0][:1] == MARKED or x[0] != BAG and set(x[1]) & set("+*"):
                continue
            at, kind = f"{place}.{j}", tag_of(x) if tag_of(x) in REGIONS else x[0][:1]
            if kind in found and 2 * max((slots[p]["pages"] for p in under(at)), default=0) > pages:
                found[kind].append(at)
            seek(x, at)

    seek(wrapper, "")
    for kind, places in found.items():
        outer = [p for p in places if not any(p.startswith(f"{q}.") for q in places)]
        if outer:
            best = max(outer, key=mass)
            while kind == MAIN:  # names are given to wrappers too: on to the part with that name that has most of it
                inner = max((p for p in places if p.startswith(f"{best}.")), key=mass, default=None)
                if inner is None or 2 * mass(inner) <= mass(best):
                    break
                best = inner
            return best, []
    return _walked(wrapper, slots, text, under, mass)


def _walked(wrapper: list, slots: dict[str, dict], text: dict[str, dict], under, mass) -> tuple[str, list[str]]:
    """The region of a host whose pages don't name it, and its template."""

    def headed(node: list, place: str) -> bool:
        """A heading with text, and other text besides."""
        heads: set[str] = set()

        def look(x: list, at: str, inside: bool) -> None:
            if inside and at in text:
                heads.add(at)
            for k, y in enumerate(x[2]):
                look(y, f"{at}.{k}", inside or tag_of(y) in HEADINGS)

        look(node, place, tag_of(node) in HEADINGS)
        return bool(heads) and any(p not in heads for p in under(place))

    node, place = wrapper, ""
    while True:
        parts = [(mass(f"{place}.{j}"), j) for j in range(len(node[2]))]
        pool = [(m, j) for m, j in parts if m and headed(node[2][j], f"{place}.{j}")] or [(m, j) for m, j in parts if m]
        most, j = max(pool, key=lambda x: (x[0], -x[1]), default=(0, 0))
        if 2 * most <= sum(m for m, _ in pool):
            break
        below = node[2][j]
        behind = [node[2][k] for m, k in parts if m and k != j]
        if set(below[1]) & set("+*") or tag_of(below) not in CONTAINERS or any(tag_of(x) not in CONTAINERS for x in behind):
            break
        node, place = below, f"{place}.{j}"
    # in the order of the wrapper, what stands before the first and after the last slot that varies and isn't links; a repeated group of options has no order, and what stands in an article is no template
    if _in_bag(node):
        return place, []
    named: set[str] = set()

    def listed(x: list, at: str, inside: bool) -> None:
        named.update([at] * inside)
        for k, y in enumerate(x[2]):
            listed(y, f"{at}.{k}", inside or tag_of(y) in REGIONS)

    listed(node, place, False)
    order = sorted((p for p in slots if p == place or p.startswith(f"{place}.")), key=lambda p: [int(x) for x in p.split(".")[1:]])
    template = lambda s: not s["varies"] and s["pages"] >= CONSTANT_PAGES or 2 * s["links"] > s["chars"]
    kept = [i for i, p in enumerate(order) if p in named or not template(slots[p])]
    return place, [p for i, p in enumerate(order) if kept and (i < kept[0] or i > kept[-1])]


_SHAPES = "host string, shape string, hash array<long>, chars array<long>, links array<long>"


def _read_shapes(batches):
    """(host, shape, and for each of its leaves a hash of all its text, characters, characters in links) of (host, html)."""
    for batch in small_batches(batches):
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root, texts = parse(page or "")
            root = fold(root)
            of = [[squeeze(texts[k][0]) for k in leaf[3]] for leaf in leaves(root)]
            hashes = [int(np.uint64(xxhash.xxh64_intdigest("\n".join(x).encode("utf-8", "surrogatepass"))).astype(np.int64)) for x in of]
            rows.append((host, json.dumps(bare(root)), hashes, [sum(map(len, x)) for x in of], [sum(texts[k][1] for k in leaf[3]) for leaf in leaves(root)]))
        c = list(zip(*rows)) or [[]] * 5
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:2]), *(pa.array(x, longs) for x in c[2:])], names=["host", "shape", "hash", "chars", "links"])


def wrapper_of(shapes: list[list]) -> list:
    """The shapes aligned one after the other; those that groups of later ones leave partly unmatched are aligned once more."""
    shapes = [bagged(x) for x in shapes]
    whole = shapes[0]
    for again in range(3):
        places = {p for p, _ in match(whole, whole)}
        for one in shapes[1:] if not again else shapes:
            if not again or any(p not in places for p, _ in match(one, whole)):
                whole = bagged(merge(whole, one))
    return whole


def _infer(pdf: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of a group of a host's shapes or wrappers."""
    return pd.DataFrame({"host": [pdf.host.iloc[0]], "number": [pdf.number.iloc[0]], "shape": [json.dumps(wrapper_of([json.loads(x) for x in sorted(pdf["shape"])]))]})


def _one_each(kinds: DataFrame) -> DataFrame:
    """(host, shape): one wrapper for each host of (host, sid, shape), in levels of bounded groups; the driver sees the largest host's number of groups."""
    level, most = kinds.withColumnRenamed("sid", "number"), None
    while most is None or most > 1:
        sizes = level.groupBy(F.col("host").alias("of")).agg(F.ceil(F.count("*") / GROUP_OF).alias("groups"))
        dealt = level.join(sizes, F.col("host") == F.col("of")).select("host", F.pmod("number", "groups").alias("number"), "shape")
        above = write_table(dealt.groupBy("host", "number").applyInPandas(_infer, "host string, number long, shape string"), "wrappers")
        if most is not None:
            drop_table(level)
        level, most = above, above.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    return level


def _match_shapes(batches):
    """(host, sid, slots, marked) of (host, sid, shape, wrapper)."""
    for batch in batches:
        found = [match(json.loads(a), json.loads(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        slots, marks = ([[x[k] for x in f] for f in found] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.bool_()))], names=["host", "sid", "slots", "marks"])


def _choose(batches):
    """(host, wrapper, expression, region, template) of (host, wrapper, slots, number of pages)."""
    for batch in batches:
        rows = []
        for host, wrapper, slots, pages in zip(*(batch.column(k).to_pylist() for k in range(4))):
            tree = json.loads(wrapper)
            region, template = content(tree, {s["slot"]: s for s in slots or ()}, pages)
            rows.append((host, wrapper, expression(tree), region, template))
        c = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:4]), pa.array(c[4], pa.list_(pa.string()))], names=["host", "wrapper", "expression", "region", "template"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, expression, region, template) from (host, h): the wrapper as a tree and as text, the region's place, the template's slots."""
    seen = write_table(pages.select("host", "h").mapInArrow(_read_shapes, _SHAPES).withColumn("sid", F.xxhash64("shape")), "shapes")
    kinds = write_table(seen.groupBy("host", "sid").agg(F.any_value("shape").alias("shape")), "kinds")
    whole = _one_each(kinds)
    wrapper = whole.select("host", F.col("shape").alias("wrapper"))
    matched = kinds.join(wrapper, "host").select("host", "sid", "shape", "wrapper").mapInArrow(_match_shapes, "host string, sid long, slots array<string>, marks array<boolean>")
    leaf = seen.select("host", "sid", F.posexplode(F.arrays_zip("hash", "chars", "links")).alias("pos", "s")).groupBy("host", "sid", "pos").agg(
        F.min("s.hash").alias("low"), F.max("s.hash").alias("high"), F.count("*").alias("pages"), F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links")
    )
    named = leaf.join(matched, ["host", "sid"]).withColumn("slot", F.get("slots", F.col("pos"))).withColumn("marked", F.get("marks", F.col("pos")))
    slots = named.groupBy("host", "slot").agg(
        (F.min("low") != F.max("high")).alias("varies"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("marked").alias("marked")
    )
    of_host = slots.groupBy(F.col("host").alias("of")).agg(F.collect_list(F.struct("slot", "varies", "pages", "chars", "links", "marked")).alias("slots"))
    counted = seen.groupBy("host").agg(F.count("*").alias("pages"))
    chosen = wrapper.join(counted, "host").join(of_host, F.col("host") == F.col("of"), "left").select("host", "wrapper", "slots", "pages")
    out = write_table(chosen.mapInArrow(_choose, "host string, wrapper string, expression string, region string, template array<string>"), "regions")
    for table in (seen, kinds, whole):
        drop_table(table)
    return out


def main_text(page: str, wrapper: list, region: str, template: frozenset[str]) -> str:
    """The text of a page that its match with the wrapper puts into the region."""
    root, texts = parse(page)
    root = fold(root)
    inside, every = [], []
    for (place, marked), leaf in zip(match(root, wrapper), leaves(root)):
        if not marked and place not in template:
            every += leaf[3]
            if place == region or place.startswith(f"{region}."):
                inside += leaf[3]
    text = lambda ks: squeeze([part for k in sorted(ks) for part in (" ", *texts[k][0])])
    return text(inside) or text(every)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``."""
    host = host_and_path(F.col(url))[0]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), host.alias("host"), F.col(page).alias("h"))
    known = wrappers(rows).select(F.col("host").alias("of"), "wrapper", "region", "template")

    def read(batches):
        last: tuple = (None, None)
        for batch in small_batches(batches):
            texts = []
            for h, wrapper, region, template in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if wrapper != last[0]:
                    last = (wrapper, json.loads(wrapper))
                texts.append(main_text(h or "", last[1], region, frozenset(template)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    joined = rows.join(known, F.col("host") == F.col("of"), "left").select("id", "url", "h", "wrapper", "region", "template")
    return joined.mapInArrow(read, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
