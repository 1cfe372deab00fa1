"""One pass over a page's HTML: title, first heading, language, and the main content as Markdown (a stated subset)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

DROPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "body", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li"}


class _Node:
    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("li", "p", "tr", "td", "th") and self.open[-1].tag == tag:
            self.open.pop()
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def _find(node: _Node, tag: str, kept: bool = False) -> _Node | None:
    """The first element of a name; kept: outside what is dropped."""
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag == tag:
            return n
        if kept and n.tag in DROPPED:
            continue
        stack += [k for k in reversed(n.kids) if isinstance(k, _Node)]
    return None


def _events(root: _Node) -> Iterator[tuple[str, _Node | str]]:
    """("open", node), ("text", string) and ("close", node) in order, by a stack, so that any depth will do. What is dropped is
    passed over."""
    stack: list[tuple[str, _Node | str]] = [("open", root)]
    while stack:
        kind, x = stack.pop()
        if kind == "open":
            if x.tag in DROPPED:
                continue
            stack.append(("close", x))
            stack += [("text", k) if isinstance(k, str) else ("open", k) for k in reversed(x.kids)]
        yield kind, x


def _text(node: _Node) -> str:
    return "".join(x for kind, x in _events(node) if kind == "text")


class _Markdown:
    """Blocks from the events of a page's main content."""

    def __init__(self):
        self.blocks: list[str] = []
        self.frames: list[tuple[_Node | None, list[str]]] = [(None, [])]  # open inline elements and their pieces
        self.lists: list[str] = []  # marks of the open lists
        self.items: list[str] = []  # lines of the outermost open list
        self.in_item = False
        self.heading = 0
        self.rows: list[list[str]] | None = None  # of the open table

    def flush(self) -> None:
        text = re.sub(" {2,}", " ", "".join("".join(pieces) for _, pieces in self.frames)).strip()
        self.frames = [(None, [])]
        if self.lists:
            if text:
                mark = self.lists[-1] if self.in_item else " "
                self.items.append("  " * (len(self.lists) - 1) + f"{mark} {text}")
                self.in_item = False
        elif text:
            self.blocks.append(f"{'#' * self.heading} {text}" if self.heading else text)

    def open(self, n: _Node) -> None:
        tag = n.tag
        if tag in ("img", "svg"):
            return
        if tag == "br":
            self.frames[-1][1].append("\n")
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.frames = [(None, [])]
            elif tag not in BLOCKS:
                self.frames.append((n, []))
        elif tag in BLOCKS and len(self.frames) == 1:
            if tag in ("ul", "ol"):
                self.flush()
                self.lists.append("-")
            elif tag == "li":
                self.flush()
                self.in_item = True
            elif self.lists:
                self.frames[-1][1].append(" ")  # blocks of an item stay on its line
            else:
                self.flush()
                if tag == "table":
                    self.rows = []
                elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                    self.heading = int(tag[1])
        elif tag not in BLOCKS:
            self.frames.append((n, []))

    def close(self, n: _Node) -> None:
        tag = n.tag
        if len(self.frames) > 1 and self.frames[-1][0] is n:
            inner = "".join(self.frames.pop()[1])
            bare = inner.strip()
            if tag == "a" and n.attrs.get("href") and bare:
                inner = f"[{bare}]({n.attrs['href']})"
            mark = "**" if tag in ("b", "strong") else "*" if tag in ("i", "em") else ""
            self.frames[-1][1].append(f"{mark}{bare}{mark}" if mark and bare else inner)
        elif self.rows is not None:
            if tag in ("td", "th") and self.rows:
                self.rows[-1].append("".join("".join(x) for _, x in self.frames).strip().replace("\n", " "))
                self.frames = [(None, [])]
            elif tag == "table":
                self.table()
        elif tag in BLOCKS and len(self.frames) == 1:
            if tag in ("ul", "ol") and self.lists:
                self.flush()
                self.lists.pop()
                if not self.lists and self.items:
                    self.blocks.append("\n".join(self.items))
                    self.items = []
            elif not self.lists or tag == "li":
                self.flush()
                self.in_item = False
                self.heading = 0

    def table(self) -> None:
        rows = [r for r in self.rows or [] if r]
        self.rows = None
        if rows:
            width = len(rows[0])
            bars = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
            self.blocks.append("\n".join([bars[0], "| " + " | ".join(["---"] * width) + " |", *bars[1:]]))

    def of(self, main: _Node) -> str:
        for kind, x in _events(main):
            if x is main:
                continue
            if kind == "text":
                if self.rows is None or self.rows:
                    self.frames[-1][1].append(re.sub(r"\s+", " ", x))
            elif kind == "open":
                self.open(x)
            else:
                self.close(x)
        if self.rows is not None:
            self.table()
        self.flush()
        if self.items:
            self.blocks.append("\n".join(self.items))
        return re.sub(r"\n{3,}", "\n\n", "\n\n".join(self.blocks)).strip()


def page_parts(html: str | None) -> dict:
    """title, language attribute, main content as text, and as Markdown."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    root = tree.root
    title, h1, page = _find(root, "title"), _find(root, "h1"), _find(root, "html")
    name = (_text(title).strip() if title else "") or (_text(h1).strip() if h1 else "")
    lang = page.attrs.get("lang") if page else None
    main = _find(root, "article", True) or _find(root, "main", True) or _find(root, "body", True)
    return {"title": name, "lang": lang, "content": re.sub(r"\s+", " ", _text(main)).strip() if main else "", "markdown": _Markdown().of(main) if main else ""}


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and "href" in (named := dict(attrs)):
            self.found.append(named["href"] or "")


def page_hrefs(html: str | None) -> list[str]:
    """href of every <a> in order, entities decoded, quoted or not."""
    links = _Links()
    links.feed(html or "")
    links.close()
    return links.found
