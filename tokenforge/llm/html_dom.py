"""A small DOM of a page: elements with tag, class and id, and their text."""

from __future__ import annotations

import html
import re

# Fixed values of HTML: elements without content, with raw text, and those that
# start a block; what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp svg math".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody
    tfoot thead tr ul caption""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("ul ol dl table td th body html article section div main nav aside header footer form".split())

_TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
_LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("tag", "names", "items", "label")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names = tag, names
        self.label = f"{tag}.{names}" if names else tag
        self.items: list[Node | str] = []         # children and decoded text, in order

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def parse(page: str) -> Node:
    """The tree of a page; never fails: stray ends are ignored, open elements end
    with the page, a broken tag at its end is dropped."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            stack[-1].items.append(html.unescape(s))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if not m[2]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        close = _ATTRS.match(page, m.end())
        if not close:
            end = page.find(">", m.end())
            if end < 0:
                break
            attrs, at = page[m.end():end], end + 1
        else:
            attrs, at = page[m.end():close.end() - 1], close.end()
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in SCOPE:
                    break
            continue
        names = " ".join(sorted({w.lower() for a in _LABEL.findall(attrs) for w in (a[1] or a[2] or a[3]).split()}))
        node = Node(tag, names)
        if tag in BLOCK:                                     # an open paragraph ends
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE - CLOSES[tag] and not (stack[k].tag in ("td", "th") and tag in ("tr", "tbody")):
                    break
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def blocks(nodes: list[Node], skip) -> list[str]:
    """Text blocks below the nodes in page order, without nodes that ``skip`` names."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        s = " ".join("".join(now).split())
        now.clear()
        if s:
            out.append(s)

    # an explicit stack: pages may nest deeper than Python's recursion
    todo: list = [(n, False) for n in reversed(nodes)]
    while todo:
        x, done = todo.pop()
        if done:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag in VOID:
            if x.tag == "hr":
                end()
            elif x.tag == "br":
                now.append(" ")
        elif x.tag not in RAW and not skip(x):
            if x.tag in BLOCK or x.tag == "#root":
                end()
                todo.append((x, True))
            elif x.tag in ("td", "th"):
                now.append(" ")
            todo.extend((y, False) for y in reversed(x.items))
    end()
    return out
