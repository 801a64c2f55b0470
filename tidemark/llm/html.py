"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages are aligned by simple tree matching, after runs of equal siblings are folded into one
repeated node. A wrapper holds, for each aligned node, how many pages have it and how much text it carries. Block texts
that stand at the same path on most pages are template; they are counted exactly, as (host, path, checksum) rows. The
node where most of the varying text lies is the content slot, on every page of the host.

Names of elements, roles and classes are a check: what they name as no article is no rival of the slot and goes from
inside it, unless hardly any varying text would be left or the host's article lies in it. Where a page has another
layout than its host's slot, its own tree serves as a wrapper of one page.

Wrappers are built per task and host over all pages, and merged by the same alignment in two steps, first in salted
groups, so a host with a third of all pages is shared by many tasks. Trees are aligned up to MOST_CHILDREN children a node
and DEEPEST levels. The rest is kept whole beside them, by the path of its labels instead of by alignment: the slot is
such a path, so it is found there as well. Texts are not in a wrapper, and no count is bounded.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import count, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import written
from .simhash import signed

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("head script style noscript template iframe svg canvas object select textarea".split())
ASIDE = frozenset("nav aside form footer button dialog menu".split())
CLOSES_P = BLOCKS - {"body"}
#: Open elements that a start tag closes, and the start tags that do.
IMPLIED = ((("p",), CLOSES_P), (("li",), {"li"}), (("dd", "dt"), {"dd", "dt"}), (("tr", "td", "th"), {"tr"}), (("td", "th"), {"td", "th"}), (("option",), {"option"}))
#: None is closed beyond one of these.
SCOPES = frozenset("ul ol table dl div article section main body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole class names and ids of what is no article; a name that only contains one of these says nothing.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation sidebar footer breadcrumb breadcrumbs comment comments respond reply replies related recommended share sharing social subscribe subscription newsletter popup modal overlay login signup widget pagination pager masthead".split())

#: Bounds of what is aligned. What lies beyond them is kept by its path, see rest_of().
MOST_CHILDREN, DEEPEST = 40, 40
#: Products of two lists of children beyond which they are aligned by what stands once in both.
PRODUCT = MOST_CHILDREN * MOST_CHILDREN
#: A text is template on hosts of so many pages, at a path of so large a share of them.
LEAST_PAGES, SHARE = 5, 0.6
#: Names are not believed where they would leave less of the varying text.
LEFT = 0.2
#: Counts held in a task before they are handed on.
HELD = 200_000
SALTS = 32


def checksum(text: str, at: int) -> int:
    return xxh64_intdigest(text.encode("utf-8", "surrogatepass"), at)


class Node:
    __slots__ = ("tag", "label", "at", "children", "unseen", "named")

    def __init__(self, tag: str, label: str, unseen: bool, named: int, at: int = 0) -> None:
        self.tag, self.label, self.unseen, self.at = tag, label, unseen, at  # at: checksum of the labels down to here
        self.named = named  # as no article: 1 by class or id, 2 by element or role
        self.children: list = []  # nodes and strings


class Tree(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#", "#", False, 0)
        self.open = [self.root]
        self.held: dict[str, list[int]] = defaultdict(list)  # places of the open elements by tag
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for closed, scope in IMPLIED:
            if tag in scope and (k := self._last(closed)) > self._last(SCOPES):
                self._close(k)
        a = {k: v or "" for k, v in attrs}
        inside = self.held.get("article") or self.held.get("main")
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
        named = 2 if tag in ASIDE or (tag == "header" and not inside) or a.get("role") in ROLES else int(tag not in ("html", "body") and not NAMES.isdisjoint(names))
        label = f"{tag}.{a.get('class', '')}"
        node = Node(tag, label, tag in UNSEEN or hidden, 0 if named == 1 and tag in ("article", "main") else named, checksum(label, self.open[-1].at))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.held[tag].append(len(self.open))
            self.open.append(node)

    def _last(self, tags: Iterable[str]) -> int:
        """The place of the last open element of these tags, 0 if there is none."""
        return max((self.held[t][-1] for t in tags if self.held.get(t)), default=0)

    def _close(self, k: int) -> None:
        for n in self.open[k:]:
            self.held[n.tag].pop()
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if self.held.get(tag):
            self._close(self.held[tag][-1])

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def blocks(node: Node) -> list[tuple[Node, str]]:
    """(block element, text) in page order; white space folded, empty ones left out. Elements named as no article are
    blocks of their own, and the text around them is one block as if they were not there."""
    out: list[tuple[int, Node, str]] = []
    serial = count()

    def flush(held: list, owner: Node) -> None:
        if text := " ".join("".join(t for _, t in held).split()):
            out.append((next(k for k, t in held if t.strip()), owner, text))
        held.clear()

    first: list = []
    stack: list = [(node, node, first, first, 0)]  # element, block element, its text and that of its parent, next child
    while stack:
        n, owner, held, outer, k = stack.pop()
        if k == 0:
            if n.named and n is not node:
                owner, held = n, []
            elif n.tag in BLOCKS:
                flush(held, owner)
                owner = n
        while k < len(n.children):
            c = n.children[k]
            k += 1
            if isinstance(c, str):
                held.append((next(serial), c))
            elif c.tag == "br":
                held.append((next(serial), " "))
            elif not c.unseen:
                stack += [(n, owner, held, outer, k), (c, owner, held, held, 0)]
                break
        else:
            if n.tag in BLOCKS or n.named or not stack:
                flush(held, owner)
    return [(owner, text) for _, owner, text in sorted(out, key=lambda x: x[0])]


def masses(found: list[tuple[Node, str]]) -> dict[int, int]:
    """Characters by the identity of the block element."""
    total: dict[int, int] = {}
    for owner, text in found:
        total[id(owner)] = total.get(id(owner), 0) + len(text)
    return total


def put(rest: dict, above: str, label: str, mass: int, named: int) -> str:
    """Add a node to a rest, below the entry `above` ("0": the rest's owner); its key there."""
    key = str(checksum(label, int(above)))
    if key in rest:
        rest[key][2] += mass
        rest[key][3] = min(rest[key][3], named)
    else:
        rest[key] = [above, label, mass, named]
    return key


def rest_of(rest: dict, children: list[dict], above: str = "0") -> None:
    """Add wrappers and all below them to a rest: (entry above, label, characters, named) by the checksum of the labels
    from the rest's owner down, parents first. Nodes of one path are one entry, so a rest grows with the different paths."""
    stack = [(c, above) for c in reversed(children)]
    while stack:
        c, at = stack.pop()
        key = put(rest, at, c["l"], c["m"], c.get("d", 0))
        merge_rest(rest, c.get("x", {}), key)
        stack += [(x, key) for x in reversed(c["c"])]


def merge_rest(rest: dict, other: dict, above: str = "0") -> None:
    """Add the entries of another rest, whose owner is the entry `above`."""
    keys = {"0": above}
    for key, (at, label, mass, named) in other.items():
        keys[key] = put(rest, keys[at], label, mass, named)


def deeper(node: Node, mass: dict[int, int], size: dict[int, int]) -> dict:
    """The rest of a node of the last level: all elements below it that have text."""
    rest: dict = {}
    stack = [(c, "0") for c in reversed(node.children)]
    while stack:
        c, at = stack.pop()
        if not isinstance(c, str) and not c.unseen and size[id(c)]:
            key = put(rest, at, c.label, mass.get(id(c), 0), c.named)
            stack += [(x, key) for x in reversed(c.children)]
    return rest


def folded(node: Node, mass: dict[int, int], depth: int = 0) -> dict:
    """A page's tree as a wrapper of one page: label, n, mass (characters), named, children, and x, the rest, where there is
    one. Elements without blocks of their own or below are left out."""
    children: list[dict] = []
    own = mass.get(id(node), 0)
    rest: dict = {}
    if depth == DEEPEST:
        rest = deeper(node, mass, sizes(node, mass))
    else:
        for c in node.children:
            if not isinstance(c, str) and not c.unseen:
                f = folded(c, mass, depth + 1)
                if not f["m"] and not f["c"] and not f.get("x"):
                    continue
                if children and children[-1]["l"] == f["l"] and children[-1]["d"] == f["d"]:
                    children[-1] = combined(children[-1], f, 1)
                else:
                    children.append(f)
    return {"l": node.label, "n": 1, "m": own, "d": node.named, "c": children, **({"x": rest} if rest else {})}


def whole(w: dict) -> int:
    """Characters of a wrapper's node and all below it."""
    return w["m"] + sum(map(whole, w["c"])) + sum(x[2] for x in w.get("x", {}).values())


def shape(w: dict) -> tuple[int, int]:
    """(checksum of the labels below and here, number of nodes) of a wrapper, kept with it while it is aligned."""
    if "s" not in w:
        below = [shape(c) for c in w["c"]]
        w["s"] = (hash((w["l"], *(h for h, _ in below))), 1 + sum(n for _, n in below))
    return w["s"]


def anchored(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
    """Pairs of two long lists in order: shapes, and then labels, that stand once in both and keep the order of the most;
    between those, the next child of the same label. No product of the lists is formed."""
    pairs = [(-1, -1), (len(a), len(b))]
    for key in (lambda x: shape(x)[0], lambda x: x["l"]):
        more = []
        for (i, j), (x, y) in pairwise(pairs):
            one = [Counter(map(key, part)) for part in (a[i + 1 : x], b[j + 1 : y])]
            at = {key(b[q]): q for q in range(j + 1, y)}
            both = [(p, at[k]) for p in range(i + 1, x) if one[0][k := key(a[p])] == 1 and one[1][k] == 1 and a[p]["l"] == b[at[k]]["l"]]
            tails: list[int] = []  # the longest run of rising places in b
            ends: list[tuple[int, int]] = []
            back: dict[tuple[int, int], tuple[int, int] | None] = {}
            for pair in both:
                k = bisect_left(tails, pair[1])
                back[pair] = ends[k - 1] if k else None
                tails[k : k + 1], ends[k : k + 1] = [pair[1]], [pair]
            run = []
            pair = ends[-1] if ends else None
            while pair is not None:
                run.append(pair)
                pair = back[pair]
            more += [(i, j), *reversed(run)]
        pairs = [*more, (len(a), len(b))]
    out = []
    for (i, j), (x, y) in pairwise(pairs):
        if i >= 0:
            out.append((i, j))
        places: dict[str, list[int]] = defaultdict(list)
        for q in range(j + 1, y):
            places[b[q]["l"]].append(q)
        last = j
        for p in range(i + 1, x):
            own = places.get(a[p]["l"], [])
            k = bisect_left(own, last + 1)
            if k < len(own):
                last = own[k]
                out.append((p, last))
    return out


def matching(a: list[dict], b: list[dict], known: dict) -> list[tuple[int, int]]:
    """Simple tree matching of two ordered lists of children: the pairs of the heaviest alignment that keeps the order.
    Equal ends are paired first; lists whose product is large are aligned by what stands once in both."""
    if [x["l"] for x in a] == [x["l"] for x in b]:
        return [(i, i) for i in range(len(a))]
    head = 0
    while head < min(len(a), len(b)) and shape(a[head]) == shape(b[head]):
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and shape(a[-1 - tail]) == shape(b[-1 - tail]):
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    ends = [(i, i) for i in range(head)], [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    if len(x) * len(y) > PRODUCT:
        return [*ends[0], *((i + head, j + head) for i, j in anchored(x, y)), *ends[1]]
    w = [[weight(p, q, known) for q in y] for p in x]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i + head, j + head))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return [*ends[0], *pairs[::-1], *ends[1]]


def weight(a: dict, b: dict, known: dict) -> int:
    """Number of pairs in the best matching of two trees; 0 if their labels differ. Trees of one shape match whole, and what
    was matched once is known for the rest of the alignment."""
    if a["l"] != b["l"]:
        return 0
    if shape(a) == shape(b):
        return shape(a)[1]
    if (key := (id(a), id(b))) not in known:
        pairs = matching(a["c"], b["c"], known)
        known[key] = (pairs, 1 + sum(weight(a["c"][i], b["c"][j], known) for i, j in pairs))
    return known[key][1]


def combined(a: dict, b: dict, n: int | None = None, known: dict | None = None) -> dict:
    """The wrapper of the pages of both; what only one has keeps its place. With n, both are parts of one page."""
    known = {} if known is None else known
    pairs = known[id(a), id(b)][0] if (id(a), id(b)) in known else matching(a["c"], b["c"], known)
    children, i, j = [], 0, 0
    for x, y in [*pairs, (len(a["c"]), len(b["c"]))]:
        children += a["c"][i:x] + b["c"][j:y]
        if x < len(a["c"]) and y < len(b["c"]):
            children.append(combined(a["c"][x], b["c"][y], n, known))
        i, j = x + 1, y + 1
    rest: dict = {}
    for side in (a, b):
        merge_rest(rest, side.get("x", {}))
    if len(children) > MOST_CHILDREN:
        most = set(sorted(range(len(children)), key=lambda k: (-children[k]["n"], -children[k]["m"], k))[:MOST_CHILDREN])
        rest_of(rest, [c for k, c in enumerate(children) if k not in most])
        children = [c for k, c in enumerate(children) if k in most]
    return {"l": a["l"], "n": n or a["n"] + b["n"], "m": a["m"] + b["m"], "d": min(a.get("d", 0), b.get("d", 0)), "c": children, **({"x": rest} if rest else {})}


def plain(w: dict) -> dict:
    """A wrapper without its shapes, which hold in one process only."""
    return {**{k: w[k] for k in ("l", "n", "m", "d")}, "c": [plain(c) for c in w["c"]], **({"x": w["x"]} if w.get("x") else {})}


def opened(w: dict) -> list[dict]:
    """Turns the rests of a wrapper into nodes and gives all nodes, each after the one above it. A rest's node that has an
    aligned one of its path beside it adds to the heaviest of those, as slots are paths."""
    order, stack = [], [w]
    while stack:
        x = stack.pop()
        order.append(x)
        rest = x.pop("x", {})
        new: dict[str, dict] = {"0": x}
        for key, (above, label, mass, named) in rest.items():
            over = new[above]
            if "_by" not in over:
                over["_by"] = {}
                for c in sorted(over["c"], key=whole_mass):
                    over["_by"][c["l"]] = c
            if (c := over["_by"].get(label)) is None:
                c = over["_by"][label] = {"l": label, "n": 1, "m": 0, "d": named, "c": []}
                over["c"].append(c)
            c["m"] += mass
            c["d"] = min(c["d"], named)
            new[key] = c
        for c in new.values():
            c.pop("_by", None)
        stack += reversed(x["c"])
    return order


def whole_mass(w: dict) -> int:
    """Characters of an aligned node and all below it, without a bound on the levels."""
    total, stack = 0, [w]
    while stack:
        x = stack.pop()
        total += x["m"] + sum(r[2] for r in x.get("x", {}).values())
        stack += x["c"]
    return total


def varying(w: dict, template: dict[int, int]) -> dict:
    """The wrapper with its rests as nodes and with v, the varying characters of each node and all below it. `template`:
    characters by path that do not vary."""
    total: dict[int, int] = {}
    order = opened(w)
    w["at"] = 0
    for x in order:
        total[x["at"]] = total.get(x["at"], 0) + x["m"]
        for c in x["c"]:
            c["at"] = checksum(c["l"], x["at"])
    for x in reversed(order):
        same = min(1, template.get(x["at"], 0) / max(1, total[x["at"]]))
        x["v"] = x["m"] * (1 - same) + sum(c["v"] for c in x["c"])
    return w


def check_names(w: dict) -> dict:
    """Marks u, the varying text of each node less what is named as no article. A name does not count where the node
    holds the host's article with half of the varying text, or where under LEFT of the text would be left without it;
    then the heaviest such node stays."""
    total = w["v"]
    order, stack = [], [w]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += reversed(x["c"])
    w["d"] = 0
    for x in reversed(order):  # whether an article lies below, by the names as they are before any is cleared
        x["holds"] = any(c["d"] == 0 and (c["l"].split(".")[0] in ("article", "main") and 2 * c["v"] >= total or c["holds"]) for c in x["c"])
    for x in order:
        if x["d"] == 1 and 2 * x["v"] >= total and x["holds"]:
            x["d"] = 0

    def left() -> list[dict]:
        named, under = [], set()
        for x in order:
            if id(x) in under or x["d"]:
                if id(x) not in under:
                    named.append(x)
                under.update(map(id, x["c"]))
        for x in reversed(order):
            x["u"] = 0.0 if x["d"] else x["v"] - sum(c["v"] for c in x["c"]) + sum(c["u"] for c in x["c"])
        return named

    while (named := left()) and w["u"] < LEFT * total:
        max(named, key=lambda x: x["v"])["d"] = 0
    return w


def slot(w: dict) -> list[str]:
    """Labels from the root down to the node that holds most of the varying text; an article is not split."""
    path = []
    check_names(w)
    total = w["u"]
    while True:
        path.append(w["l"])
        heavy = max(w["c"], key=lambda c: c["u"], default=None)
        if heavy is None or heavy["u"] < 0.6 * total or w["l"].split(".")[0] in ("article", "main") or (tag := heavy["l"].split(".")[0]) not in {*BLOCKS, "html"} or tag in ("p", "li", "tr", "tbody", "td", "ul", "ol", "table"):
            return path
        w = heavy


def descend(node: Node, path: list[str], size: dict[int, int]) -> Node | None:
    """The page's node at the slot's path, the one with the most text; null where the page has none."""
    for label in path[1:]:
        same = [c for c in node.children if not isinstance(c, str) and not c.unseen and c.label == label]
        if not same:
            return None
        node = max(same, key=lambda c: size[id(c)])
    return node


def sizes(root: Node, mass: dict[int, int]) -> dict[int, int]:
    """Characters of each node and all below it, by identity."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if not isinstance(c, str) and not c.unseen]
    size: dict[int, int] = {}
    for n in reversed(order):
        size[id(n)] = mass.get(id(n), 0) + sum(size[id(c)] for c in n.children if not isinstance(c, str) and not c.unseen)
    return size


def checked(place: Node, mass: dict[int, int], size: dict[int, int]) -> set[int]:
    """Identities of the slot's nodes that are not named as no article. If under LEFT of the slot's text were left, or
    its largest article with half of the text went, the heaviest node that is named stays. Each node is met once."""
    holds: set[int] = set()  # nodes that hold an article below which no name marks
    order, stack = [], [place]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if not isinstance(c, str) and not c.unseen]
    for n in reversed(order):
        if any(not isinstance(c, str) and not c.unseen and not c.named and (c.tag in ("article", "main") or id(c) in holds) for c in n.children):
            holds.add(id(n))
    kept, left, serial = set(), 0, count()
    named: list[tuple] = []  # the heaviest first, and a heap of those that may be the host's article
    rivals: list[tuple] = []
    stack = [place]
    while True:
        while stack:
            n = stack.pop()
            kept.add(id(n))
            left += mass.get(id(n), 0)
            for c in n.children:
                if not isinstance(c, str) and not c.unseen:
                    if c.named:
                        entry = (-size[id(c)], next(serial), c)
                        heapq.heappush(named, entry)
                        if c.named == 1 and 2 * size[id(c)] >= size[id(place)] and id(c) in holds:
                            heapq.heappush(rivals, entry)
                    else:
                        stack.append(c)
        heap = rivals or named
        if not named or (not rivals and left >= LEFT * size[id(place)]):
            return kept
        chosen = heapq.heappop(heap)[2]
        if heap is rivals:
            named = [x for x in named if x[2] is not chosen]  # few nodes hold half of the text
            heapq.heapify(named)
        stack.append(chosen)


def below(node: Node) -> list[Node]:
    """The nodes under one that no name of their own marks."""
    out, stack = [], [node]
    while stack:
        new = [c for c in stack.pop().children if not isinstance(c, str) and not c.unseen and not c.named]
        out += new
        stack += new
    return out


def articles(node: Node, kept: set[int]) -> list[Node]:
    """Outermost article elements, else main elements, among the kept."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [(node, False)]
    while stack:
        n, inside = stack.pop()
        for c in reversed(n.children):
            if not isinstance(c, str) and id(c) in kept:
                if c.tag in found and not (c.tag == "article" and inside):
                    found[c.tag].append(c)
                stack.append((c, inside or c.tag == "article"))
    return found["article"] or found["main"]


def main_text(html: str, path: list[str] | None, template: set[int]) -> str:
    """The blocks of the content slot, narrowed to its largest article if it has any, without the host's template."""
    root = Tree(html).root
    rows = blocks(root)
    mass = masses(rows)
    size = sizes(root, mass)
    place = descend(root, path, size) if path else None
    if place is None or not size[id(place)]:
        place = descend(root, slot(varying(folded(root, mass), {})), size) or root
    kept = checked(place, mass, size)
    if own := articles(place, kept):
        place = max(own, key=lambda a: sum(mass.get(id(n), 0) for n in [a, *below(a)]))
        kept = checked(place, mass, size)
    rows = [(n, t) for n, t in rows if id(n) in kept]
    same = [checksum(t, n.at) in template for n, t in rows]
    if 2 * sum(len(t) for (_, t), s in zip(rows, same, strict=True) if s) >= sum(len(t) for _, t in rows):
        same = [False] * len(rows)  # most of the slot recurs: copies of an article, not a template
    return "\n".join(t for (_, t), s in zip(rows, same, strict=True) if not s)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The path of each host's content slot, from its wrapper and the characters of its template."""
    for batch in batches:
        paths = []
        for wrapper, template in zip(batch["wrapper"], batch["template"], strict=True):
            chars: dict[int, int] = {}
            for row in template if template is not None else ():
                at = row["at"] % (1 << 64)
                chars[at] = chars.get(at, 0) + row["chars"]
            paths.append(slot(varying(json.loads(wrapper), chars)))
        yield batch[["host", "template"]].assign(path=paths)


SCHEMA = "host string, wrapper string, pages long, at long, key long, n long, chars long"


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrappers, and on how many pages of a host each block text stands at each path."""
    found: dict[str, dict] = {}
    counts: dict[tuple, list[int]] = {}

    def handed() -> Iterator[pd.DataFrame]:
        if found:
            none = [None] * len(found)
            yield pd.DataFrame({"host": list(found), "wrapper": [json.dumps(plain(w)) for w in found.values()], "pages": [w["n"] for w in found.values()], **{c: pd.Series(none, dtype="Int64") for c in ("at", "key", "n", "chars")}})
            found.clear()
        if counts:
            hosts, ats, keys = zip(*counts, strict=True)
            none = [None] * len(hosts)
            ns, chars = zip(*counts.values(), strict=True)
            yield pd.DataFrame({"host": hosts, "wrapper": none, "pages": pd.Series(none, dtype="Int64"), "at": signed(ats), "key": signed(keys), "n": ns, "chars": chars})
            counts.clear()

    for batch in batches:
        for host, html in zip(batch["host"], batch["html"], strict=True):
            root = Tree(html).root
            rows = blocks(root)
            page = folded(root, masses(rows))
            found[host] = combined(found[host], page) if host in found else page
            seen = set()
            for owner, text in rows:
                place = (host, owner.at, checksum(text, owner.at))
                count = counts.setdefault(place, [0, 0])
                count[0] += place not in seen
                count[1] += len(text)
                seen.add(place)
            if len(found) > 2000 or len(counts) > HELD:  # a task can meet very many hosts
                yield from handed()
    yield from handed()


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    w = None
    for x in group["wrapper"].sort_values():
        w = combined(w, json.loads(x)) if w else json.loads(x)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(plain(w))]})


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, path) from pages (host, html). template: (at, key, chars) of the texts that stand at the same path
    on most of the host's pages, null where there are none; path: labels down to the content slot. Counts are exact."""
    schema = "host string, wrapper string"
    partial = written(pages.mapInPandas(_partial, SCHEMA), "blocks")
    trees = partial.where("wrapper IS NOT NULL")
    salted = trees.select("host", "wrapper", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt"))
    wrappers = salted.groupBy("host", "salt").applyInPandas(_merge, schema).groupBy("host").applyInPandas(_merge, schema)
    sizes = trees.groupBy("host").agg(F.sum("pages").alias("_pages"))
    texts = partial.where("wrapper IS NULL").groupBy("host", "at", "key").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).where(F.col("n") >= SHARE * LEAST_PAGES)
    often = texts.join(sizes, "host").where((F.col("_pages") >= LEAST_PAGES) & (F.col("n") >= SHARE * F.col("_pages")))
    template = often.groupBy("host").agg(F.collect_list(F.struct("at", "key", "chars")).alias("template"))
    ruled = wrappers.join(template, "host", "left").select("host", "wrapper", "template")
    return written(ruled.mapInPandas(slots, ruled.drop("wrapper").withColumn("path", F.array(F.lit(""))).schema), "wrappers")


def extract_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`pages` without its html, with `text` and n_chars (code points), which take the place of columns of these names.

    A null or empty html, or one without an article, gives the empty text; a null url is a host of its own. Repeated
    rows give each; an empty table gives no rows. Pages of any length are read whole. Of equally heavy slots the first in
    page order is the text; of equally heavy articles inside one slot it is the same one in every run.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), host_of(F.col(f"`{url_col}`").cast("string")).alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.join(induce_wrappers(rows.select("host", "html")), "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for host, html, path, template in zip(batch["host"], batch["html"], batch["path"], batch["template"], strict=True):
                if host not in parsed:
                    if len(parsed) > 2000:
                        parsed.clear()
                    parsed[host] = None if path is None else list(path), {r["key"] % (1 << 64) for r in (template if template is not None else ())}
                texts.append(main_text(html, *parsed[host]))
            yield batch[["_row"]].assign(text=texts)

    out = rows.select("_row", "html", "host", "path", "template").mapInPandas(run, rows.select("_row", F.lit("").alias("text")).schema)
    return out.select("_row.*", "text", F.char_length("text").cast("long").alias("n_chars"))


def html_query(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "url", "html"))
