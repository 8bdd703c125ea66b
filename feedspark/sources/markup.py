"""Reading one HTML page inside a task: a node list and the selectors templates need.

Supported selectors: tag, ``.class``, ``#id``, ``[a]``, ``[a=v]``, ``[a^=v]``, ``[a$=v]``,
``[a*=v]``, ``[a~=v]``, ``:not(...)`` of one of those, descendant, child and comma.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser
from operator import attrgetter

# Elements without content, and what an opening tag closes implicitly.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CLOSES |= {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table select article section div nav body html".split())


# Tags without anything unusual, and elements whose content is no markup.
_PLAIN = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&]*")*)>')
_PAIRS = re.compile(r' ([a-z-]+)="([^"]*)"')
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())

_index = attrgetter("index")


class Node:
    __slots__ = ("tag", "attrs", "parent", "index", "end", "text_from", "text_to")

    def __init__(self, tag, attrs, parent, index, text_from):
        self.tag, self.attrs, self.parent, self.index = tag, attrs, parent, index
        self.end = self.text_to = None
        self.text_from = text_from


class Page(HTMLParser):
    """Nodes in document order; a node's descendants are the nodes up to its ``end``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self._by_tag: dict[str, list[Node]] = {}
        self.texts: list[str] = []
        self._open: list[Node] = []
        self.feed(html)
        self.close()
        self._close_down_to(0)

    def _close_down_to(self, depth):
        while len(self._open) > depth:
            node = self._open.pop()
            node.end, node.text_to = len(self.nodes), len(self.texts)

    def _close_implied(self, tag):
        closed = {"p"} if tag in BLOCKS else CLOSES.get(tag)
        if closed is None:
            return
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth].tag in closed:
                self._close_down_to(depth)
                return
            if self._open[depth].tag in SCOPES:
                return

    def parse_starttag(self, i):
        """A plain tag is read by one expression; the parser reads all others."""
        found = _PLAIN.match(self.rawdata, i)
        if not found or found[1] in _RAW:
            return super().parse_starttag(i)
        self.lasttag = found[1]
        self.handle_starttag(found[1], _PAIRS.findall(found[2]) if found[2] else ())
        return found.end()

    def parse_endtag(self, i):
        found = _PLAIN_END.match(self.rawdata, i)
        if not found or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(found[1])
        return found.end()

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        parent = self._open[-1] if self._open else None
        # The first of repeated attributes counts.
        node = Node(tag, dict(reversed(attrs)), parent, len(self.nodes), len(self.texts))
        self.nodes.append(node)
        self._by_tag.setdefault(tag, []).append(node)
        self._open.append(node)
        if tag in VOID:
            self._close_down_to(len(self._open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth].tag == tag:
                self._close_down_to(depth)
                return

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def handle_data(self, data):
        self.texts.append(data)

    def text(self, node: Node | None) -> str:
        return "".join(self.texts[node.text_from : node.text_to]).strip() if node else ""

    def select(self, selector: str, within: Node | None = None):
        """Matching nodes in document order, below ``within`` if given.

        When every alternative names a tag, only nodes of these tags are looked at.
        """
        chains, tags = compile_selector(selector)
        low, high = (within.index + 1, within.end) if within else (0, len(self.nodes))
        if tags is None:
            inside = self.nodes[low:high]
        else:
            inside = []
            for tag in tags:
                named = self._by_tag.get(tag, [])
                start = bisect_left(named, low, key=_index)
                inside += named[start : bisect_left(named, high, start, key=_index)]
            if len(tags) > 1:
                inside.sort(key=_index)
        return (n for n in inside if any(_matches(n, chain) for chain in chains))

    def first(self, selector: str, within: Node | None = None) -> Node | None:
        return next(iter(self.select(selector, within)), None)


_NAME = r"[A-Za-z_][\w-]*|\*"
_SIMPLE = re.compile(
    rf"(?P<tag>{_NAME})|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"
    r"|:not\((?P<not>[^()]*)\)"
)
_COMBINATOR = re.compile(r"\s*(>)\s*|\s+")
OPERATORS = {
    "=": lambda have, want: have == want,
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
    "~=": lambda have, want: want in have.split(),
}


def _compound(text: str, at: int):
    """Tests of one compound selector, where it ends, and the tag it names."""
    tests, tag = [], None
    while match := _SIMPLE.match(text, at):
        at = match.end()
        g = match.groupdict()
        if g["tag"]:
            if g["tag"] != "*":
                tag = g["tag"].lower()
                tests.append(lambda n, t=tag: n.tag == t)
        elif g["cls"]:
            tests.append(lambda n, c=g["cls"]: c in (n.attrs.get("class") or "").split())
        elif g["id"]:
            tests.append(lambda n, i=g["id"]: n.attrs.get("id") == i)
        elif g["attr"]:
            name, op = g["attr"].lower(), g["op"]
            want = next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), "")
            if op:
                tests.append(lambda n, a=name, f=OPERATORS[op], w=want: a in n.attrs and f(n.attrs[a] or "", w))
            else:
                tests.append(lambda n, a=name: a in n.attrs)
        else:
            inner, end, _ = _compound(g["not"].strip(), 0)
            if end != len(g["not"].strip()):
                raise ValueError(f'unsupported selector "{text}"')
            tests.append(lambda n, inner=inner: not all(t(n) for t in inner))
    return tests, at, tag


_COMPILED: dict[str, tuple] = {}


def compile_selector(selector: str):
    """Compiled selectors are kept, up to a bound; functions travel by value, so the
    cache is a plain dictionary."""
    if selector not in _COMPILED:
        if len(_COMPILED) >= 4096:
            _COMPILED.clear()
        _COMPILED[selector] = _compile(selector)
    return _COMPILED[selector]


def _compile(selector: str):
    """Alternatives of (compound, combinator to its left) pairs, rightmost first.

    The tags of the rightmost compounds come along, or None if one of them names no tag.
    """
    chains, tags = [], set()
    for part in re.split(r",(?![^\[(]*[\])])", selector):
        text, at, steps, combinator = part.strip(), 0, [], None
        while True:
            tests, end, tag = _compound(text, at)
            if end == at:
                raise ValueError(f'unsupported selector "{selector}"')
            steps.append((tests, combinator))
            gap = _COMBINATOR.match(text, end)
            if not gap:
                break
            combinator, at = gap.group(1) or " ", gap.end()
        if end != len(text):
            raise ValueError(f'unsupported selector "{selector}"')
        chains.append(steps[::-1])
        tags.add(tag)
    return chains, None if None in tags else sorted(tags)


def _matches(node: Node, chain, step: int = 0) -> bool:
    tests, combinator = chain[step]
    if not all(test(node) for test in tests):
        return False
    if combinator is None:
        return True
    above = node.parent
    while above is not None:
        if _matches(above, chain, step + 1):
            return True
        if combinator == ">":
            return False
        above = above.parent
    return False
