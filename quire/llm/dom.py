"""A small HTML tree: elements and runs of text as flat lists in page order.

One pass over tags with regular expressions; no recursion, so depth and length are
bounded by memory only. Contents of scripts, styles and other elements without text of
their own are dropped here.
"""

from __future__ import annotations

import html
import re
from collections import Counter

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?>[^=>]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe svg math object head title textarea select canvas audio video".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SCOPE = frozenset("html body article aside div section main td th blockquote nav header footer form fieldset figure table".split())
#: Elements that an opening tag ends: the tag, those it ends, and where the search stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Dom:
    """Nodes in page order. ``tag`` is ``#text`` for a run of text beside block elements.

    Quotes mean something only after an equals sign. A tag or comment that is not closed
    takes the rest of the page with it. Every step moves on or costs what it removes, so
    time grows with the length whatever is left open.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.text, self.link = ["#root"], [-1], [""], [[]], [0]
        self.order: list[tuple[int, int]] = []  # (block, index of its piece), in page order
        self.opened: Counter[str] = Counter()  # open elements by name
        stack, block, anchors = [0], [0], 0
        endless: set[str] = set()  # names without a closing tag further on
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            m = _OPEN.match(source, lt) if lt >= 0 else None
            literal = lt >= 0 and m is None and source[lt + 1 : lt + 2] not in ("!", "?", "/")
            stop = n if lt < 0 else lt + literal
            if stop > at:
                self._add(block[-1], source[at:stop], anchors)
            if lt < 0 or literal:
                at = stop
                continue
            if m is None:
                comment = source.startswith("<!--", lt)
                end = source.find("-->" if comment else ">", lt + 4 if comment else lt + 1)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            rest = _REST.match(source, m.end())
            if rest is None:
                break
            at, raw, name = rest.end(), rest[0][:-1], m[2].lower()
            if m[1]:
                if name == "br" or name == "p" and not self.opened["p"]:
                    self._add(block[-1], " ", 0)
                    continue
                if not self.opened[name]:
                    continue
                while True:
                    k = self._close(stack)
                    anchors -= self.tag[k] == "a"
                    if block[-1] == k:
                        block.pop()
                    if self.tag[k] == name:
                        break
                continue
            if name in SILENT and not raw.rstrip().endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else (n if name in ("script", "style") else at)
                self._add(block[-1], " ", 0)
                continue
            if name in VOID:
                self._add(block[-1], " ", 0)
                continue
            anchors = self._imply(name, stack, block, anchors)
            k = len(self.tag)
            self.tag.append(name), self.parent.append(stack[-1]), self.attrs.append(raw), self.text.append([]), self.link.append(0)
            if raw.rstrip().endswith("/") and name not in BLOCK:
                continue
            stack.append(k)
            self.opened[name] += 1
            anchors += name == "a"
            if name in BLOCK:
                block.append(k)

    def _close(self, stack: list[int]) -> int:
        k = stack.pop()
        self.opened[self.tag[k]] -= 1
        return k

    def _imply(self, name: str, stack: list[int], block: list[int], anchors: int) -> int:
        ends, stop = _ENDS.get(name, (None, None))
        if ends is None and name in BLOCK and name not in ("tbody", "thead", "tfoot"):
            ends, stop = {"p"}, _SCOPE
        if ends and any(self.opened[t] for t in ends):
            for i in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[i]]
                if t in ends:
                    first = stack[i]
                    while len(stack) > i:
                        anchors -= self.tag[self._close(stack)] == "a"
                    while block[-1] >= first:  # nodes are numbered in page order
                        block.pop()
                    break
                if t in stop:
                    break
        return anchors

    def _add(self, block: int, text: str, anchors: int) -> None:
        """Add raw text to a block's current piece; a new piece begins where another block came between."""
        pieces = self.text[block]
        if not (self.order and self.order[-1][0] == block):
            if not text.strip():
                return
            self.order.append((block, len(pieces)))
            pieces.append([])
        pieces[-1].append(text)
        if anchors:
            self.link[block] += len(text)

    def blocks(self) -> list[tuple[int, str]]:
        """``(node, text)`` of every piece of text in page order, references decoded and white space as one space."""
        out = []
        for block, i in self.order:
            raw = "".join(self.text[block][i])
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((block, text))
        return out


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}
