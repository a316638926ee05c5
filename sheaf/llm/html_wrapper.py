"""HTML extraction by union-free regular expressions (wrappers) inferred from pages of one host.

A page is a tree of elements and texts. A wrapper generalises pages of a host: an element
list is matched against another from left to right. What both sides hold word for word is matched first; between
such anchors a mismatch is resolved as

* a text slot, where both sides hold text that differs;
* an attribute slot, where elements of one name differ in their marks and neither is found further on;
* a repeated group, where the unmatched element equals the one just matched (the repeats
  before it fold into the group, too);
* an optional part, where one side's element is found further on in the other, or nowhere.

No alternatives (unions) are needed. Wrappers of wrappers are built by the same alignment: tasks fold their pages into a
wrapper for each host, and these are merged in rounds, a bounded number at a time, so
that every page counts and a hot host is no large group anywhere. A wrapper of more than ``MOST_NODES``
nodes folds its runs of like elements and then loses the optional parts that the fewest pages have, so
generated class names cannot make it grow with the pages. Only wrappers are bounded, no page's text is.

Each element of a wrapper keeps over all its pages the words outside and inside links,
whether they vary (slots) or are constant. The wrapper's main region is the element that
holds most varying text of its own without boilerplate. A page's region is the
element at the same place, and the region's part of the wrapper is matched with it: slots, groups and
what the wrapper does not know are the article; what is constant over the host goes, that is
text that stands word for word on at least half of its pages (and on ``FEW`` or more), if
the region has more varying than constant text. A constant heading stays where other text follows it.
Parts that are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments by
their element's name or role go, too, and those that a class or id names so: by its last word (``cookie-banner``), or
by its first if only words for containers follow (``comment-list``), never by another part of a word (``side-effects``),
and not where an article would be left without any text.

Nulls: null or empty html gives an empty text; a page whose host is null or cannot be read belongs
to the host "". Repeated rows come out once for each row; equal pages count once in a task's wrapper. Markup
may be nested to any depth and pages be of any length. A page that has no main region by its wrapper
is read by its own. Ties between regions go to the one that comes last in the page. An empty table gives an empty result. Only the
columns page_id, url and html are read, so others of any name do not matter.
"""

from __future__ import annotations

import html as html_lib
import json
import math
import re
import sys
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import materialize

#: Nodes of a wrapper, nodes of all wrappers that a task holds, and nodes of a region's rule, at most.
MOST_NODES, HELD_NODES, RULE_NODES = 1500, 150_000, 300
#: Pages of a host that must have a text for it to be constant, at least.
FEW = 4
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.S)

# Names of HTML's elements, fixed by its standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body dd dt head html li tbody td tfoot th thead tr legend summary".split())
#: A start tag ends open elements of these names, up to the nearest of the second.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody", "table"), "thead": ("tr td th thead tbody", "table"), "tfoot": ("tr td th thead tbody", "table"), "option": ("option", "select")}

#: Elements that are never part of an article's text.
NO_TEXT = frozenset("script style noscript template iframe head title textarea select button input option svg canvas object audio video map form nav footer aside menu dialog fieldset xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
#: Words of class and id that mark such parts, and words for containers that may follow them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail widget widgets footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comments comment commentlist respond disqus reply replies pagination pager skip copyright".split()
)
CONTAINERS = frozenset("area bar block box button buttons container content form frame group holder icons inner item items line links list message outer panel posts row section slot strip thread top unit widget wrap wrapper".split())
#: Marks that are also words for things: behind another word they count only if that one says where on the page it is.
AMBIGUOUS = frozenset("share rail related reply replies promotion alert comment comments notice notices banner subscription consent".split())
PLACES = frozenset("left right side top bottom site page post article social user reader header footer main global cookie privacy blog entry".split())
#: A header inside an article holds its title; outside, the site's.
ARTICLE_LIKE = frozenset(("article", "main"))
#: Elements that may hold a page's whole article, forms of server-side pages too.
HOLDERS = frozenset(("div", "section", "span", "form", "fieldset"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
WORDS = re.compile(r"[a-z]+|\d+")
#: A mark that stands for any.
ANY = "*"
#: Why an element is dropped.
BY_NAME, BY_CLASS = 1, 2


class Node:
    """An element, or a text (name ""), of a page or of a wrapper."""

    __slots__ = ("name", "mark", "drop", "text", "children", "kind", "pages", "varied", "constant", "linked", "key", "fixed", "below")

    def __init__(self, name: str, mark: str = "", drop: int = 0, text: list[str] | str | None = None):
        self.name, self.mark, self.drop, self.text = name, mark, drop, text
        self.children: list[Node] = []
        self.kind = ""  # "" one, "?" optional, "+" repeated, "*" both
        self.pages, self.varied, self.constant, self.linked = 1, 0, 0, 0
        self.key = 0  # a hash of all it holds, 0 if that varies
        self.below = 0  # nodes of a page, at its root
        self.fixed = False  # it stood word for word on two pages, and matches nothing else

    def like(self, other: Node) -> bool:
        return self.name == other.name and (self.mark == other.mark or ANY in (self.mark, other.mark)) and not self.fixed and not other.fixed


def parse(page: str) -> Node:
    """A page's tree. End tags that are left out are supplied; those that open nothing are ignored."""
    root = Node("html")
    stack, names, at = [root], ["html"], 0
    opened: dict[str, int] = defaultdict(int)
    opened_ever = False

    def add_text(raw: str) -> None:
        top = stack[-1]
        if top.children and top.children[-1].name == "":
            top.children[-1].text.append(raw)
        else:
            top.children.append(Node("", text=[raw]))

    def close(found: int) -> None:
        for x in names[found:]:
            opened[x] -= 1
        del stack[found:], names[found:]

    def last(wanted: str) -> int:
        k = len(names) - 1
        while names[k] != wanted:
            k -= 1
        return k

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add_text(page[at:])
            break
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        name = m[1]
        if not name:
            continue
        name = name.lower()
        if page[m.start() + 1] == "/":
            if opened[name] > 0:
                k = last(name)
                # An inline end tag closes nothing beyond a block.
                if name in BLOCKS or not any(x in BLOCKS for x in names[k + 1 :]):
                    close(k)
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P and opened["p"] > 0:
            k = last("p")
            if not any(x in ("td", "th", "table", "button", "object") for x in names[k:]):
                close(k)
        elif name in ENDS:
            ends, stop = (x.split() for x in ENDS[name])
            if any(opened[x] > 0 for x in ends):
                k = len(names) - 1
                while k > 0 and names[k] not in stop:
                    if names[k] in ends:
                        close(k)
                    k -= 1
        node = element(name, m[2], opened["article"] + opened["main"] > 0)
        if name in ARTICLE_LIKE:
            opened_ever = True
            # What holds the article is no menu or sidebar, whatever its class says ("has-sidebar").
            for holder in stack:
                if holder.name in HOLDERS:
                    holder.drop = 0
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name == "title" or name == "textarea":
                node.children.append(Node("", text=[page[at : end.start() if end else n]]))
            at = end.end() if end else n
        elif name not in VOID and not m[2].endswith("/"):
            stack.append(node)
            names.append(name)
            opened[name] += 1
    order = list(walk(root))
    if opened_ever and any(n.drop == BY_CLASS for n in order):
        # Classes alone do not make boilerplate of all that an article holds.
        kept: dict[int, bool] = {}
        for node in reversed(order):
            kept[id(node)] = any(t.strip() for t in node.text) if node.name == "" else not node.drop and any(kept[id(c)] for c in node.children)
        for article in order:
            if article.name in ARTICLE_LIKE and not article.drop and not kept[id(article)]:
                for node in walk(article):
                    if node.drop == BY_CLASS:
                        node.drop = 0
    for node in order:
        if node.name == "":
            node.text = "".join(node.text)
    if any(n.name == "form" and n.drop for n in order):
        _keep_forms(order)
    return root


def _keep_forms(order: list[Node]) -> None:
    """A form that holds more than half of a page's words, and many, is the page's frame: what is in it is read like any other part."""
    words: dict[int, int] = {}
    for node in reversed(order):
        words[id(node)] = len(node.text.split()) if node.name == "" else sum(words[id(c)] for c in node.children if not c.drop or c.name == "form")
    most = words[id(order[0])]
    for node in order:
        if node.name == "form" and node.drop and words[id(node)] >= 50 and 2 * words[id(node)] > most:
            node.drop = 0


def walk(root: Node) -> Iterator[Node]:
    """A node and all below it, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(node.children)


def is_marked(token: str) -> bool:
    """Whether a class or id names boilerplate: its last word does, or its first with words for containers alone behind it."""
    words = [w for w in WORDS.findall(token) if not w.isdigit()]
    if not words:
        return False
    if words[0] in MARKS and all(w in CONTAINERS or w in MARKS for w in words[1:]):
        return True
    return words[-1] in MARKS and (words[-1] not in AMBIGUOUS or all(w in PLACES or w in MARKS for w in words[:-1]))


def element(name: str, rest: str, inside: bool) -> Node:
    role, own = "", []
    if "=" in rest:
        for key, value in ATTRIBUTE.findall(rest):
            key = key.lower()
            if key in ("class", "id"):
                own += value.strip("\"'").lower().split()
            elif key == "role":
                role = value.strip("\"'").lower()
    sure = name in NO_TEXT or role in ROLES or (name == "header" and not inside)
    drop = BY_NAME if sure else BY_CLASS if name not in ARTICLE_LIKE and any(map(is_marked, own)) else 0
    return Node(name, " ".join(sorted({w for x in own for w in WORDS.findall(x) if not w.isdigit()})), drop)


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) or 1


def key_of(name: str, mark: str, keys: list[int]) -> int:
    """The key of an element with children of these keys."""
    return digest(f"{name} {mark}\0{keys}")


def wrap(root: Node) -> Node:
    """A page as a wrapper of its own: white space between elements goes, words are counted, and everything has the key of what it holds. All text is constant until another page says otherwise."""
    order, linked = [], {id(root): False}
    for node in walk(root):
        if node.children:
            node.children = [c for c in node.children if c.name or c.text.strip()]
        for c in node.children:
            linked[id(c)] = linked[id(node)] or node.name == "a"
        order.append(node)
    for node in reversed(order):
        if node.name == "":
            words = node.text.split()
            node.text = " ".join(words)
            node.key = digest(node.text)
            node.text = node.text[:40]  # for reading; the key compares
            if linked[id(node)]:
                node.linked = len(words)
            else:
                node.constant = len(words)
        else:
            keys, constant, links = [], 0, 0
            for c in node.children:
                keys.append(c.key)
                if not c.drop:
                    constant += c.constant
                    links += c.linked
            node.key, node.constant, node.linked = key_of(node.name, node.mark, keys), constant, links
    root.below = len(order)
    return root


def merge_one(a: Node, b: Node) -> Node:
    """``a`` generalised to match what ``b`` matches. The two are alike."""
    a.pages += b.pages
    a.linked += b.linked
    same = a.key == b.key and a.key != 0
    if a.name == "":
        a.varied += b.varied + (0 if same else a.constant + b.constant)
        a.constant = a.constant + b.constant if same else 0
        if not same:
            a.text, a.key = None, 0
        return a
    if a.mark != b.mark:
        a.mark = ANY
    a.children = [merge_one(x, y) for x, y in zip(a.children, b.children, strict=True)] if same else align(a.children, b.children)
    if not same:
        a.key = 0
    a.drop = min(a.drop, b.drop)
    a.varied = sum(c.varied for c in a.children if not c.drop)
    a.constant = sum(c.constant for c in a.children if not c.drop)
    if set(b.kind) - set(a.kind):
        a.kind = kind("+" in a.kind or "*" in a.kind or "+" in b.kind or "*" in b.kind, "?" in a.kind or "*" in a.kind or "?" in b.kind or "*" in b.kind)
    return a


def kind(repeated: bool, optional: bool) -> str:
    return "*" if repeated and optional else "+" if repeated else "?" if optional else ""


def again(a: Node, b: Node) -> bool:
    """Whether ``b`` may repeat ``a``."""
    return a.like(b) or (a.key != 0 and a.key == b.key)


def repeat(a: Node, b: Node) -> Node:
    pages = max(a.pages, b.pages)  # the same pages have both
    a = merge_one(a, b)
    a.pages = pages
    a.kind = kind(True, a.kind in ("?", "*"))
    return a


def option(a: Node) -> Node:
    a.kind = kind(a.kind in ("+", "*"), True)
    return a


def anchors(left: list[Node], right: list[Node]) -> list[tuple[int, int]]:
    """Places of what both lists hold word for word, ascending in both: the longest such sequence."""
    if len(left) == 1 == len(right):
        return [(0, 0)] if left[0].key and left[0].key == right[0].key and (left[0].constant or left[0].linked) else []
    places: dict[int, list[int]] = {}
    for i, a in enumerate(left):
        if a.key and (a.constant or a.linked):
            places.setdefault(a.key, []).append(i)
    used: dict[int, int] = defaultdict(int)
    pairs = []
    for j, b in enumerate(right):
        if b.key in places and used[b.key] < len(places[b.key]):
            pairs.append((places[b.key][used[b.key]], j))
            used[b.key] += 1
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tops, i)
        before[k] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [i], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(left: list[Node], right: list[Node]) -> list[Node]:
    out: list[Node] = []

    def fold(node: Node) -> None:
        """``node`` repeats the last of ``out``; equal ones before that fold into the group."""
        last = repeat(out.pop(), node)
        while out and again(out[-1], last):
            last = repeat(out.pop(), last)
        out.append(last)

    def between(left: list[Node], right: list[Node]) -> None:
        i = j = 0
        further: list[dict[str, list[int]] | None] = [None, None]

        def find(side: int, items: list[Node], node: Node, start: int) -> int:
            if further[side] is None:
                further[side] = {}
                for k, x in enumerate(items):
                    if not x.fixed:
                        further[side].setdefault(x.name, []).append(k)
            places = further[side].get(node.name, ())
            for at in range(bisect_left(places, start), len(places)):
                if items[places[at]].like(node):
                    return places[at]
            return -1

        while i < len(left) and j < len(right):
            a, b = left[i], right[j]
            if a.fixed or b.fixed:
                if a.fixed:
                    out.append(option(a))
                    i += 1
                else:
                    out.append(option(b))
                    j += 1
            elif a.like(b):
                merged = merge_one(a, b)
                if out and again(out[-1], merged) and out[-1].kind in ("+", "*"):
                    fold(merged)
                else:
                    out.append(merged)
                i, j = i + 1, j + 1
            elif out and again(out[-1], b) and b.name:
                fold(b)
                j += 1
            elif out and again(out[-1], a) and a.name:
                fold(a)
                i += 1
            else:
                to_b, to_a = find(0, left, b, i + 1), find(1, right, a, j + 1)
                if to_b >= 0 and (to_a < 0 or to_b - i <= to_a - j):
                    out.extend(option(x) for x in left[i:to_b])
                    i = to_b
                elif to_a >= 0:
                    out.extend(option(x) for x in right[j:to_a])
                    j = to_a
                elif a.name == b.name and bool(a.drop) == bool(b.drop):
                    out.append(merge_one(a, b))  # an attribute slot
                    i, j = i + 1, j + 1
                else:
                    out.extend((option(a), option(b)))
                    i, j = i + 1, j + 1
        for rest in (left[i:], right[j:]):
            for x in rest:
                if out and again(out[-1], x) and x.name:
                    fold(x)
                else:
                    out.append(option(x))

    i = j = 0
    for x, y in anchors(left, right):
        if i < x or j < y:
            between(left[i:x], right[j:y])
        same = merge_one(left[x], right[y])
        same.fixed = True
        out.append(same)
        i, j = x + 1, y + 1
    if i < len(left) or j < len(right):
        between(left[i:], right[j:])
    return out


def size(node: Node) -> int:
    return sum(1 for _ in walk(node))


def bounded(wrapper: Node, most: int = MOST_NODES) -> Node:
    """The wrapper with its runs of like elements folded, and without the optional parts that the fewest pages have, until it is small enough or has neither.
    A page alone stays as it is: only another page tells what of it is constant."""
    if wrapper.pages == 1 or size(wrapper) <= most:
        return wrapper
    for node in walk(wrapper):
        out: list[Node] = []
        for c in node.children:
            if c.name and out and out[-1].like(c) and not (c.fixed and c.pages > 1):
                out[-1] = repeat(out[-1], c)
            else:
                out.append(c)
        if len(out) < len(node.children):
            node.children, node.key = out, 0
    least = 1
    while size(wrapper) > most * 4 // 5:  # so that the next page does not bring it over the limit again
        rare = [c.pages for c in walk(wrapper) if c.kind in ("?", "*")]
        if not rare:
            break
        least = max(least, min(rare))
        for node in walk(wrapper):
            node.children = [c for c in node.children if c.kind not in ("?", "*") or c.pages > least]
        least *= 2
    return wrapper


def join(a: Node, b: Node) -> Node:
    return bounded(merge_one(a, b))


FIELDS = ("name", "mark", "drop", "text", "kind", "pages", "varied", "constant", "linked", "key", "fixed")


def to_rows(root: Node) -> list[list]:
    """A tree as rows, parents first, each with the number of its children: no nesting, however deep the tree is."""
    return [[*(getattr(n, f) for f in FIELDS), len(n.children)] for n in walk(root)]


def from_rows(rows: list[list]) -> Node:
    root, stack = None, []
    for *values, count in rows:
        node = Node("")
        for f, v in zip(FIELDS, values, strict=True):
            setattr(node, f, v)
        while stack and stack[-1][1] == 0:
            stack.pop()
        if stack:
            stack[-1][0].children.append(node)
            stack[-1][1] -= 1
        else:
            root = node
        stack.append([node, count])
    return root


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tags and text, for reading."""
    if node.name == "":
        body = "#text" if node.text is None else node.text
    else:
        body = f"<{node.name}>{''.join(map(expression, node.children))}</{node.name}>"
    return f"({body}){node.kind}" if node.kind else body


def main_region(wrapper: Node) -> list[Node]:
    """The elements from below the root to the region that holds the article.

    An article or main element that holds at least half the text wins; else, going down
    from the root, the child that holds more than four fifths of the text of its parent.
    """

    def weight(n: Node) -> float:
        # Text that varies from page to page is content; text that never does is more likely the site's.
        return n.varied + (n.constant if n.pages == 1 else 0.25 * n.constant) - 0.5 * n.linked

    total = max(weight(wrapper), 1e-9)
    stack, best, depth = [(wrapper, None)], None, 0
    while stack:
        node, path = stack.pop()
        for c in node.children:
            if c.name and not c.drop:
                here = (c, path)
                if c.name in ARTICLE_LIKE and weight(c) >= 0.5 * total and (best is None or best[0].name == "main" or _depth(here) <= depth):
                    best, depth = here, _depth(here)
                stack.append((c, here))
    if best:
        path = []
        while best:
            path.append(best[0])
            best = best[1]
        return path[::-1]
    node, path = wrapper, []
    while True:
        heavy = [c for c in node.children if c.name in BLOCKS and not c.drop and c.kind not in ("+", "*") and weight(c) > 0.8 * weight(node)]
        if not heavy or weight(node) <= 0 or heavy[0].name in ("p", "pre", "blockquote", "ul", "ol", "table"):
            return path
        node = heavy[0]
        path.append(node)


def _depth(path: tuple | None) -> int:
    n = 0
    while path:
        n, path = n + 1, path[1]
    return n


def regions(root: Node, path: list[tuple[str, str]]) -> list[Node]:
    """The page's elements at the wrapper's place; where the last step repeats, all of them."""
    level = [root]
    for name, mark in path:
        level = [c for n in level for c in n.children if c.name == name and (c.mark == mark or mark == ANY) and not c.drop]
        if not level:
            return []
    return level


def rule_of(wrapper: Node) -> dict:
    """What pages are read by: the place of the region, and the region's part of the wrapper with its constant texts marked."""
    path = main_region(wrapper)
    region = path[-1] if path else wrapper
    steps: list[list] = []
    for n in path:
        if steps and steps[-1][:2] == [n.name, n.mark]:
            steps[-1][2] += 1
        else:
            steps.append([n.name, n.mark, 1])
    least = max(FEW, region.pages / 2)
    trusted = region.varied > region.constant
    part = from_rows(to_rows(region))
    for node in walk(part):
        # A constant part goes where its text is the site's; an element that also has slots stays, and its constant texts go.
        node.fixed = trusted and node.key != 0 and node.pages >= least and (node.constant + node.linked > 0)
    # What is constant counts wherever it stands in the region, so its keys go beside the tree, which is bounded.
    keys, stack = set(), [part]
    while stack:
        node = stack.pop()
        if node.fixed:
            keys.add(node.key)
        else:
            stack += node.children
    level, count = [part], 1
    while level:  # by levels; of parts that the tree does not reach, names, classes and keys tell
        below = []
        for node in level:
            node.children = [] if node.fixed else node.children[: max(0, RULE_NODES - count)]
            count += len(node.children)
            below += node.children
        level = below
    return {"path": steps, "part": [[n.name, n.mark, n.drop, n.kind, n.key if n.fixed else 0, int(n.fixed), len(n.children)] for n in walk(part)], "keys": sorted(keys)}


def load_rule(text: str) -> tuple[list[tuple[str, str]], Node, frozenset[int]]:
    """The path, the region's part, and the keys of its constant parts."""
    rule = json.loads(text)
    return [(name, mark) for name, mark, times in rule["path"] for _ in range(times)], from_rows([[n, m, d, None, k, 1, 0, 0, 0, key, bool(f), c] for n, m, d, k, key, f, c in rule["part"]]), frozenset(rule["keys"])


def apply_rule(region: Node, part: Node, keys: frozenset[int]) -> None:
    """Matches a page's region (a wrapper of its own) with the wrapper's part: what the wrapper has as boilerplate is marked to be dropped, what it has as article is not."""
    todo: list[tuple[Node, Node | None]] = [(region, part)]
    while todo:
        node, known = todo.pop()
        at, others = 0, [k for k in known.children if not k.fixed] if known else []
        for c in node.children:
            if c.key in keys:
                c.drop, c.fixed = BY_NAME, True
                continue
            # The next part that it can be: the same again where that repeats, or one further on.
            k = next((k for k in range(at, len(others)) if others[k].name == c.name and others[k].mark in (c.mark, ANY)), None)
            if k is not None:
                at = k if others[k].kind in ("+", "*") else k + 1
                if c.name:
                    c.drop = others[k].drop
            if c.name and (keys or k is not None):
                todo.append((c, None if k is None else others[k]))


def blocks(region: Node) -> list[str]:
    """The texts of the region's blocks in page order: references decoded, white space runs as one space. A constant heading comes with what follows it."""
    out: list[str] = []
    run: list[str] = []
    waiting: list[str] = []

    def end() -> None:
        text = " ".join(html_lib.unescape("".join(run)).split())
        run.clear()
        if text:
            out.extend(waiting)
            waiting.clear()
            out.append(text)

    stack: list[Node | None] = [None, *reversed(region.children)]
    while stack:
        c = stack.pop()
        if c is None:
            end()
        elif c.name == "":
            if not c.drop:
                run.append(c.text)
        elif c.name in ("br", "wbr"):
            run.append(" " if c.name == "br" else "")
        elif c.drop:
            if c.name not in BLOCKS:
                run.append(" ")
                continue
            end()
            if c.fixed and c.name in HEADINGS:
                waiting[:] = [t for x in walk(c) if x.name == "" and (t := " ".join(html_lib.unescape(x.text).split()))]
                waiting[:] = [" ".join(waiting)] if waiting else []
        elif c.name in BLOCKS:
            end()
            stack.append(None)
            stack += reversed(c.children)
        else:
            stack += reversed(c.children)
    end()
    return out


def extract(page: str | None, rule: tuple[list[tuple[str, str]], Node, frozenset[int]] | None) -> str:
    """The main text of a page, by its host's rule or else its own."""
    if not page:
        return ""
    root = parse(page)
    found = regions(root, rule[0]) if rule else []
    if found:
        if rule[1].children or rule[2]:
            for r in found:
                if rule[2]:
                    key_texts(r)
                apply_rule(r, *rule[1:])
    else:
        whole = wrap(parse(page))
        found = regions(root, [(n.name, n.mark) for n in main_region(whole)]) or [root]
    return "\n\n".join(b for r in found for b in blocks(r))


def key_texts(region: Node) -> None:
    """Gives every node of a page's region the key that it has in wrappers."""
    for node in reversed(list(walk(region))):
        if node.name == "":
            words = node.text.split()
            node.key = digest(" ".join(words)) if words else 0
        else:
            node.key = key_of(node.name, node.mark, [c.key for c in node.children if c.key])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


PARTIAL = "host string, part long, wrapper binary"


def _dump(wrapper: Node) -> bytes:
    return json.dumps(to_rows(wrapper), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")


def _load(data: bytes) -> Node:
    return from_rows(json.loads(data.decode("utf-8", "surrogatepass")))


def _partials(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["host", "part", "wrapper"])


def infer(pages: DataFrame, fan_in: int = 64) -> DataFrame:
    """One wrapper for each host, from all of its pages. No task merges more than about ``fan_in`` wrappers of a host."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(10**6)
        part, total = TaskContext.get().partitionId(), 0
        held: dict[str, Node] = {}
        sizes: dict[str, int] = {}
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if not page or (known := (host, digest(page))) in seen:
                    continue
                seen.add(known)
                new = wrap(parse(page))
                held[host] = merge_one(held[host], new) if host in held else new
                total += new.below
                sizes[host] = sizes.get(host, 0) + new.below
                if sizes[host] > MOST_NODES:  # a bound of its size: all that it has been merged with
                    before, held[host] = sizes[host], bounded(held[host])
                    sizes[host] = size(held[host]) // 2
                    total += sizes[host] - before
                if total > HELD_NODES:
                    yield _partials([(h, part, _dump(w)) for h, w in held.items()])
                    held, sizes, total = {}, {}, 0
                if len(seen) > 100_000:
                    seen.clear()
        if held:
            yield _partials([(h, part, _dump(w)) for h, w in held.items()])

    def merge(table: pa.Table) -> pa.Table:
        sys.setrecursionlimit(10**6)
        table = table.sort_by("part")
        out = None
        for data in table["wrapper"].to_pylist():
            out = _load(data) if out is None else join(out, _load(data))
        return pa.Table.from_batches([_partials([(table["host"][0].as_py(), table["part"][0].as_py(), _dump(out))])])

    wrappers = materialize(pages.select("host", "html").mapInArrow(fold, PARTIAL), "wrappers")
    most = wrappers.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("p")).agg(F.max("n"), F.max("p")).first()
    if most[0] is None:
        return wrappers.select("host", "wrapper")
    left, parts = most[0], most[1] + 1
    while left > 1:
        groups = 1 if left <= fan_in else math.ceil(left / fan_in)
        dealt = wrappers.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long"))
        wrappers = materialize(dealt.groupBy("host", "part").applyInArrow(merge, PARTIAL), "wrappers")
        left = groups
    return wrappers.select("host", "wrapper")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(10**6)
        for batch in batches:
            found = [json.dumps(rule_of(_load(w)), separators=(",", ":")) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], names=["h", "rule"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, texts = batch.slice(at, 256), []
                for page, rule in zip(part.column("html").to_pylist(), part.column("rule").to_pylist(), strict=True):
                    if rule is not None and rule not in known:
                        known = {} if len(known) > 500 else known
                        known[rule] = load_rule(rule)
                    texts.append(extract(page, known.get(rule)))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rules = materialize(infer(own).mapInArrow(places, "h string, rule string"), "rules")
    joined = own.join(rules, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "rule")
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return joined.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
