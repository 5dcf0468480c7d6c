"""Main text of web pages by wrapper induction over the pages of a host.

A few seed pages of a host are merged into a tree of slots: trees are aligned by simple tree matching, nodes that
pair share a slot, others get slots of their own, and a run of siblings is one repeated slot. Every page is aligned with
its host's slots, and figures of each slot are gathered over all pages: on how many it is, with which texts, how much
text varies and how much is links. They decide: texts that stay the same are template, slots of links are menus, and the
slot that holds nearly all varying text is the article. What elements and names say (article, nav, class="ad") decides
alone only on pages of hosts with few pages, and on pages where the wrapper finds nothing; elsewhere it takes away what
stands inside the slot of the article.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Container

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, map_rows, salted_join, table

#: Pages that a host's slots are made of, at most; pages from which on its figures decide; siblings that make a repeated slot.
SEEDS, MIN_SUPPORT, RUN = 4, 5, 4
#: A text is template if it is on this share of the pages with its slot; a slot is a menu if this share of its text is links.
CONSTANT, LINKS = 0.8, 0.6
#: The article's slot holds this share of the varying text around it; an element named like none keeps its text from this share of the article on.
ARTICLE, NAMED = 0.8, 0.25

# Elements whose text is no text, that end a block, that have no content, that are never the article.
_RAW = frozenset("script style iframe textarea title xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_APART = frozenset("nav header footer aside form menu dialog button script style noscript template svg math iframe object textarea title head select xmp".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "optgroup", "summary"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div body html main nav aside footer header form td th blockquote".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumb\w*|sidebar|side-bar|cookie\w*|consent|notice|"
    r"comment|comments|disqus|replies|footer|header|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|overlay|widget)(?:$|[\s_-])",
    re.I,
)
# Quotes matter only right after a sign of equality; "<!-->" is a whole comment.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*+)?)*+)(>|\Z)|[^<]+|<",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_SPACE = re.compile(r"\s+")


#: Names that, whole, tell what a block of text in an article is.
_SURE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion newsletter cookie-notice".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 th dt caption".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure table dl".split())
_INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var".split())


class Node:
    """An element: apart (its text is none, by element or role; inherited), hinted (by a part of its name), sure (by a whole name), main (in an article; inherited)."""

    __slots__ = ("tag", "up", "kids", "text", "raw", "apart", "hinted", "sure", "main", "link", "shape")

    def __init__(self, tag: str, up: int, raw: bool, apart: bool, hinted: bool, sure: bool, main: bool, link: bool):
        self.tag, self.up, self.kids, self.text, self.raw, self.apart, self.hinted, self.sure, self.main, self.link, self.shape = tag, up, [], [], raw, apart, hinted, sure, main, link, -1


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """The elements in document order, and the pieces of text in page order with their elements; a block's end is '\\n'.

    Tags that HTML lets stand open (p, li, td ...) are closed as HTML says; what is open at the end is closed
    there; an unfinished tag at the end is no text. Elements without content are no nodes.
    """
    nodes = [Node("#root", -1, False, False, False, False, False, False)]
    stack, pieces, text, at = [(0, "#root")], [], page or "", 0
    open_: dict[str, int] = {}  # open elements by name, so that a stray end tag costs nothing
    while at < len(text):
        m = _TOKEN.match(text, at)
        at, tag = m.end(), m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                pieces.append((stack[-1][0], entities.unescape(piece) if "&" in piece else piece))
            continue
        tag = tag.lower()
        if m[4] != ">":
            break
        if tag in _BLOCK:
            pieces.append((stack[-1][0], "\n"))
        if m[1]:
            if open_.get(tag):
                close(stack, open_, {tag}, ())
            continue
        if tag in _CLOSES_P:
            close(stack, open_, {"p"}, _SCOPE)
        elif tag == "body":
            close(stack, open_, {"head"}, {"body"})
        if tag in _SIBLINGS:
            close(stack, open_, _SIBLINGS[tag], {"ul", "ol", "dl", "table", "select"} - {tag})
        if tag in _VOID:
            continue
        attrs: dict[str, str] = {}
        for k, a, b, c in _ATTR.findall(m[3]) if m[3] else ():
            attrs.setdefault(k.lower(), a or b or c)  # of an attribute given twice the first counts
        at_up = stack[-1][0]
        up = nodes[at_up]
        hints = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        top = tag in ("html", "body", "article", "main")
        apart = up.apart or tag in _APART or not top and attrs.get("role", "").lower() in _ROLES
        hinted = not top and len(hints) > 1 and bool(_HINT.search(hints))
        sure = hinted and not _SURE.isdisjoint(hints.lower().split())
        if hinted and tag in _TEXTUAL and up.main:  # "share-prices" or "notice" on a paragraph of an article say nothing
            hinted = sure
        main = up.main or not apart and not hinted and (tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody")
        node = Node(tag, at_up, up.raw or tag in _RAW or tag in ("head", "noscript", "template", "svg", "math", "object"), apart, hinted, sure, main, up.link or tag == "a")
        up.kids.append(len(nodes))
        stack.append((len(nodes), tag))
        open_[tag] = open_.get(tag, 0) + 1
        nodes.append(node)
        if tag in _RAW:
            end = _RAW_END[tag].search(text, at)
            at = end.start() if end else len(text)
    for i, piece in pieces:
        nodes[i].text.append(piece)
    return nodes, pieces


def close(stack: list[tuple[int, str]], open_: dict[str, int], tags: set[str], scope: Container[str]) -> None:
    """Closes the innermost open element of these names, with all in it, unless one of the scope stands between."""
    if not any(open_.get(t) for t in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][1] in tags:
            for _, tag in stack[i:]:
                open_[tag] -= 1
            del stack[i:]
            return
        if stack[i][1] in scope:
            return


def squeeze(pieces: list[str]) -> str:
    return _SPACE.sub(" ", "".join(pieces)).strip(" ")


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


class Slots:
    """A host's tree of slots: tag, slot above, whether it repeats, slots below in order, and texts that two seeds share."""

    def __init__(self, tags: list[str], ups: list[int], repeats: list[bool], texts: list[list[int]]):
        self.tags, self.ups, self.repeats, self.texts = tags, ups, repeats, [set(t) for t in texts]
        self.kids: list[list[int]] = [[] for _ in tags]
        for i, up in enumerate(ups):
            if up >= 0:
                self.kids[up].append(i)

    def dump(self) -> str:
        return json.dumps([self.tags, self.ups, self.repeats, [sorted(t) for t in self.texts]])


class Shapes:
    """Numbers for the shapes of subtrees, by tag and shapes of kids; subtrees of one shape match alike."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.kids: list[tuple[int, ...]] = []

    def number(self, nodes: list[Node]) -> None:
        for node in reversed(nodes):  # kids stand after their parent
            key = node.tag, tuple(nodes[k].shape for k in node.kids)
            node.shape = self.known.setdefault(key, len(self.tags))
            if node.shape == len(self.tags):
                self.tags.append(node.tag)
                self.kids.append(key[1])


#: Up to so many cells a table of two lists of kids is made of Python numbers, above by rows of an array; the result is the same.
SMALL = 4096


class Matching:
    """Simple tree matching of pages with slots: the most pairs of nodes with equal tags, kids in order; a repeated slot
    pairs with any number of siblings in a row."""

    def __init__(self, slots: Slots):
        self.slots, self.shapes = slots, Shapes()
        self.memo: dict[tuple[int, int], int] = {}

    def value(self, shape: int, slot: int) -> int:
        todo, memo, tags, kids = [(shape, slot, False)], self.memo, self.shapes.tags, self.shapes.kids
        while todo:
            s, u, ready = todo.pop()
            if (s, u) in memo:
                continue
            below = self.slots.kids[u]
            if ready:
                memo[s, u] = 1 + self.pairs(kids[s], below, False)[0]
                continue
            todo.append((s, u, True))
            by_tag: dict[str, list[int]] = {}
            for k in below:
                by_tag.setdefault(self.slots.tags[k], []).append(k)
            todo.extend((x, k, False) for x in set(kids[s]) for k in by_tag.get(tags[x], ()) if (x, k) not in memo)
        return memo[shape, slot]

    def pairs(self, x: tuple[int, ...] | list[int], below: list[int], trace: bool = True) -> tuple[int, list[tuple[int, int]]]:
        """(most pairs below, [(place in x, place in below)] of one way to it) for two lists of kids whose values are known."""
        n, m = len(x), len(below)
        if not n or not m:
            return 0, []
        if n * m > SMALL:
            return self.pairs_by_rows(x, below, trace)
        memo, repeats = self.memo, self.slots.repeats
        rows = [[0] * (m + 1)]
        for s in x:
            last, row, best = rows[-1], [0], 0
            for j, u in enumerate(below):
                v, t = memo.get((s, u), 0), last[j + 1]
                if v:
                    t = t + v if repeats[u] else max(t, last[j] + v)
                best = max(best, t)
                row.append(best)
            rows.append(row)
        out, i, j = [], n, m
        while trace and i and j:
            if rows[i][j] == rows[i][j - 1]:
                j -= 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - (not repeats[below[j - 1]])
        return rows[n][m], out

    def pairs_by_rows(self, x, below: list[int], trace: bool) -> tuple[int, list[tuple[int, int]]]:
        repeats = np.array([self.slots.repeats[u] for u in below])
        values = {s: np.array([self.memo.get((s, u), 0) for u in below], np.int64) for s in set(x)}
        last, bits = np.zeros(len(below) + 1, np.int64), []
        for s in x:
            v = values[s]
            t = np.where(repeats, last[1:] + v, np.where(v > 0, np.maximum(last[1:], last[:-1] + v), last[1:]))
            row = np.r_[0, np.maximum.accumulate(t)]
            if trace:
                bits.append((np.packbits(row[1:] == row[:-1]), np.packbits(row[1:] == last[1:])))
            last = row
        out, i, j = [], len(x), len(below)
        while trace and i and j:
            left, up = bits[i - 1]
            at, bit = (j - 1) >> 3, 7 - ((j - 1) & 7)
            if left[at] >> bit & 1:
                j -= 1
            elif up[at] >> bit & 1:
                i -= 1
            else:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - (not repeats[j - 1])
        return int(last[-1]), out

    def align(self, nodes: list[Node]) -> list[int]:
        """The slot of each node, -1 without one."""
        self.shapes.number(nodes)
        if len(self.memo) > 500_000:
            self.memo.clear()
        found = [-1] * len(nodes)
        found[0] = 0
        self.value(nodes[0].shape, 0)
        todo = [0]
        while todo:
            at = todo.pop()
            kids, below = nodes[at].kids, self.slots.kids[found[at]]
            if not kids or not below:
                continue
            for i, j in self.pairs([nodes[k].shape for k in kids], below)[1]:
                found[kids[i]] = below[j]
                todo.append(kids[i])
        return found


class Grown:
    """A slot that is still growing."""

    __slots__ = ("tag", "kids", "repeats", "texts")

    def __init__(self, tag: str, repeats: bool = False):
        self.tag, self.kids, self.repeats, self.texts = tag, [], repeats, {}


def kind_of(slot: Grown) -> tuple[str, frozenset[str]]:
    """What siblings of a repeated slot have in common: their tag and the tags of the blocks below."""
    return slot.tag, frozenset(k.tag for k in slot.kids if k.tag not in _INLINE)


def flat(root: Grown) -> tuple[Slots, list[Grown]]:
    order, ups, todo = [], [], [(root, -1)]
    while todo:
        slot, up = todo.pop()
        todo.extend((k, len(order)) for k in reversed(slot.kids))
        order.append(slot)
        ups.append(up)
    return Slots([s.tag for s in order], ups, [s.repeats for s in order], [[h for h, seeds in s.texts.items() if len(seeds) > 1] for s in order]), order


def induce_slots(pages: list[str]) -> Slots:
    """Slots of the seed pages: nodes without a slot on one page get one beside their siblings'; runs of siblings of one kind become one."""
    root = Grown("#root")
    for number, page in enumerate(pages):
        nodes, _ = parse(page)
        slots, order = flat(root)
        found = Matching(slots).align(nodes)
        own: list[Grown | None] = [order[u] if u >= 0 else None for u in found]
        for i, node in enumerate(nodes):
            place = 0
            for k in node.kids:
                if own[k] is None:
                    own[k] = Grown(nodes[k].tag)
                    own[i].kids.insert(place, own[k])
                    place += 1
                else:
                    place = own[i].kids.index(own[k], max(0, place - 1)) + 1
            text = squeeze(node.text)
            if text and not node.raw:
                own[i].texts.setdefault(digest(text), set()).add(number)
        todo = [root]
        while todo:  # runs of RUN and more become one repeated slot, with the kids of the largest
            slot = todo.pop()
            kept, at = [], 0
            while at < len(slot.kids):
                end = at
                while end < len(slot.kids) and kind_of(slot.kids[end]) == kind_of(slot.kids[at]):
                    end += 1
                run = slot.kids[at:end]
                if len(run) >= RUN or any(k.repeats for k in run):
                    one = Grown(run[0].tag, True)
                    one.kids = max((k.kids for k in run), key=len)
                    for k in run:
                        for h, seeds in k.texts.items():
                            one.texts.setdefault(h, set()).update(seeds)
                    run = [one]
                kept += run
                at = end
            slot.kids = kept
            todo.extend(kept)
    return flat(root)[0]


def figures(page: str | None, matching: Matching) -> dict[tuple[int, int], list[int]]:
    """{(slot, text digest or 0): [pages, varying characters, characters in links, characters]} of one page.

    A digest's row tells that the page has this shared text in the slot. Nodes without a slot count for the nearest above.
    """
    nodes, _ = parse(page)
    found, out = matching.align(nodes), {}
    slot = list(found)
    for i, node in enumerate(nodes):
        if slot[i] < 0:
            slot[i] = slot[node.up]
        text = squeeze(node.text) if node.text and not node.raw else ""
        if text:
            row = out.setdefault((slot[i], 0), [1, 0, 0, 0])
            h = digest(text)
            shared = found[i] >= 0 and h in matching.slots.texts[found[i]]
            row[1] += 0 if shared or node.link else len(text)
            row[2] += len(text) if node.link else 0
            row[3] += len(text)
            if shared:
                out.setdefault((found[i], h), [1, 0, 0, 0])[1] += 0 if node.link else len(text)
    return out


def decide(slots: Slots, rows: list[tuple[int, int, int, int, int, int]], names: bool = True) -> dict | None:
    """The wrapper {article, menus, template, large} from figures (slot, digest, pages, vary, link, chars); None without one.

    article: the slot to read; menus: slots left out with all below; template: {slot: digests left out}; large: slots with
    NAMED of the article's text and more, which no name takes away.
    """
    n = len(slots.tags)
    pages, vary, link, chars = [0] * n, [0] * n, [0] * n, [0] * n
    template: dict[int, list[int]] = {}
    for u, h, k, a, b, c in rows:
        if not h:
            pages[u], vary[u], link[u], chars[u] = k, vary[u] + a, b, c
    for u, h, k, a, _, _ in rows:
        if h:
            if pages[u] >= MIN_SUPPORT and k >= CONSTANT * pages[u]:
                template.setdefault(u, []).append(h)
            else:
                vary[u] += a  # shared by seeds but not by the host's pages
    for u in range(n - 1, 0, -1):
        for x in (vary, link, chars):
            x[slots.ups[u]] += x[u]
    if max(pages, default=0) < MIN_SUPPORT or not vary[0]:
        return None
    at = 0
    while not (names and slots.tags[at] in ("article", "main")):
        best = max(slots.kids[at], key=vary.__getitem__, default=None)
        if best is None or slots.repeats[best] or slots.tags[best] in _INLINE or vary[best] < ARTICLE * vary[at]:
            break
        if any(slots.tags[k] in _TEXTUAL and vary[k] for k in slots.kids[at] if k != best):  # text beside it belongs with it
            break
        at = best
    menus = [u for u in range(n) if link[u] > LINKS * chars[u] and vary[u] < NAMED * vary[at] and slots.tags[u] not in _INLINE and slots.tags[u] not in _TEXTUAL]
    return {"article": at, "menus": menus, "template": template, "large": [u for u in range(n) if vary[u] >= NAMED * vary[at]]}


def content(nodes: list[Node], pieces: list[tuple[int, str]], found: list[int] | None = None, wrapper: dict | None = None, names: bool = True) -> str:
    """The main text: blocks in page order, joined by one space; by the wrapper if there is one, else by elements and names."""
    n = len(nodes)
    inside, gone, own = [wrapper is None] * n, [False] * n, [True] * n
    for i, node in enumerate(nodes):
        u = found[i] if found else -1
        if i:
            inside[i], gone[i] = inside[node.up], gone[node.up]
        if wrapper:
            inside[i] |= u == wrapper["article"]
            gone[i] |= u in wrapper["menus"]
            if u in wrapper["template"] and digest(squeeze(node.text)) in wrapper["template"][u]:
                own[i] = False
        # names take away containers, not what holds much of the article's text, nor its paragraphs
        large = bool(wrapper) and (u in wrapper["large"] or inside[i] and node.tag in _TEXTUAL and not node.sure)
        gone[i] |= node.raw or names and (node.apart or node.hinted and not large)
    if wrapper:
        keep_headings(nodes, pieces, inside, gone, own)
    use = [a and not b and c for a, b, c in zip(inside, gone, own)]
    if names and any(use[i] and nodes[i].main and p.strip() for i, p in pieces):
        use = [x and node.main for x, node in zip(use, nodes)]
    kept = []
    for i, piece in pieces:
        if piece == "\n" or use[i]:
            kept.append(piece)
        elif kept and kept[-1] != "\n":
            kept.append("\n")
    return squeeze(kept)


def keep_headings(nodes: list[Node], pieces: list[tuple[int, str]], inside: list[bool], gone: list[bool], own: list[bool]) -> None:
    """A heading in the article that all pages share stays if text of the page follows it before the next heading."""
    shared = [i for i, node in enumerate(nodes) if not own[i] and inside[i] and not gone[i] and node.tag in _HEADINGS]
    if not shared:
        return
    has = [False] * len(nodes)
    for i, piece in pieces:
        has[i] |= inside[i] and not gone[i] and own[i] and bool(piece.strip())
    for i in range(len(nodes) - 1, 0, -1):
        has[nodes[i].up] |= has[i]
    wanted = set(shared)
    for up in {nodes[i].up for i in shared}:
        follows = False
        for k in reversed(nodes[up].kids):
            if k in wanted and follows:
                own[k] = True
            follows = has[k] or follows and nodes[k].tag not in _HEADINGS


class Wrapper:
    """A host's slots and what was decided on them."""

    def __init__(self, slots: Slots, found: dict | None):
        self.matching, self.found = Matching(slots), found

    def text(self, page: str | None, names: bool = True) -> str:
        nodes, pieces = parse(page)
        text = content(nodes, pieces, self.matching.align(nodes), self.found, names) if self.found else ""
        return text or content(nodes, pieces, names=names)


def loaded(slots: str, decided: str | None = None) -> Wrapper:
    found = json.loads(decided) if decided else None
    if found:
        found = {"article": found["article"], "menus": set(found["menus"]), "template": {int(u): set(h) for u, h in found["template"].items()}, "large": set(found["large"])}
    return Wrapper(Slots(*json.loads(slots)), found)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points), one row a row of df.

    A null or empty html gives an empty text; very long and very deep pages are read whole; pages without a url are the
    host ''; repeated pages are extracted alike and count as often as they stand; hosts of fewer than MIN_SUPPORT pages have no
    wrapper and are read by their elements and names alone; other columns of df are not read. An empty df gives no rows.
    """
    kind = dict(df.dtypes)[id_col]
    pages = df.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"), host_of(F.col(f"`{url_col}`")).alias("host")
    )
    # one seed page of each part of a host's pages: bounded, whatever the host's size
    draw = F.xxhash64("page_id", "html")
    seeds = [F.min_by(F.when(F.pmod(draw, F.lit(SEEDS)) == k, F.col("html")), F.when(F.pmod(draw, F.lit(SEEDS)) == k, F.struct(draw, "html"))).alias(f"seed{k}") for k in range(SEEDS)]
    hosts = pages.groupBy("host").agg(F.count("*").alias("n"), *seeds)
    hosts = hosts.select("host", "n", F.array_distinct(F.array_compact(F.array(*[f"seed{k}" for k in range(SEEDS)]))).alias("seeds"))

    def induce(cols: dict[str, list]) -> dict[str, list]:
        few = [n < MIN_SUPPORT for n in cols["n"]]
        return {"host": cols["host"], "n": cols["n"], "slots": [induce_slots([] if f else s).dump() for f, s in zip(few, cols["seeds"])]}

    hosts = cut(map_rows(hosts, induce, "host string, n long, slots string", rows=16))
    hot = cut(hot_keys(hosts, ["host"], "n"))
    spread = F.struct("page_id", "url")
    paired = salted_join(pages, hosts.select("host", "slots"), ["host"], hot, spread, "left")
    held: dict[tuple, Wrapper] = {}

    def wrapper_of(*key: str | None) -> Wrapper:
        if key not in held:
            if len(held) > 256:
                held.clear()
            held[key] = loaded(*key)
        return held[key]

    def measure(cols: dict[str, list]) -> dict[str, list]:
        sums: dict[tuple[str, int, int], list[int]] = {}
        for host, page, slots in zip(cols["host"], cols["html"], cols["slots"]):
            matching = wrapper_of(slots).matching
            for (u, h), row in figures(page, matching).items() if len(matching.slots.tags) > 1 else ():
                total = sums.setdefault((host, u, h), [0, 0, 0, 0])
                for k in range(4):
                    total[k] += row[k]
        names = ("host", "slot", "digest"), ("pages", "vary", "link", "chars")
        return {x: [key[i] for key in sums] for i, x in enumerate(names[0])} | {x: [row[i] for row in sums.values()] for i, x in enumerate(names[1])}

    # both passes read the same columns in one plan, so Spark exchanges the pages once and reads that twice
    found = map_rows(paired.select("page_id", "url", "host", "html", "slots"), measure, "host string, slot int, digest long, pages long, vary long, link long, chars long")
    found = found.groupBy("host", "slot", "digest").agg(*[F.sum(c).alias(c) for c in ("pages", "vary", "link", "chars")])
    found = found.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array("slot", "digest", "pages", "vary", "link", "chars")))).alias("rows"))  # bounded by the seeds
    hosts = hosts.join(found, "host", "left")

    def settle(cols: dict[str, list]) -> dict[str, list]:
        decided = [decide(Slots(*json.loads(s)), json.loads(r)) if r else None for s, r in zip(cols["slots"], cols["rows"])]
        return {"host": cols["host"], "slots": cols["slots"], "decided": [json.dumps(d) if d else None for d in decided]}

    wrappers = map_rows(hosts.select("host", "slots", "rows"), settle, "host string, slots string, decided string")
    final = salted_join(pages, wrappers, ["host"], hot, spread, "left")

    def extract(cols: dict[str, list]) -> dict[str, list]:
        texts = [wrapper_of(slots, decided).text(page) for page, slots, decided in zip(cols["html"], cols["slots"], cols["decided"])]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(final.select("page_id", "url", "host", "html", "slots", "decided"), extract, f"page_id {kind}, url string, text string, n_chars long")


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extract": op5_html_extract}
ORACLES: dict[str, str] = {}
