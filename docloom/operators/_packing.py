"""The greedy folds over one text that window functions can't say: pieces by a budget of characters."""

from __future__ import annotations

import re

#: A Markdown table: rows, one of them the rule under the head; it takes its last line end along.
TABLE = re.compile(r"(?:\|[^\n]+\|(?:\n|\Z))+\|[-|: ]+\|(?:\n|\Z)(?:\|[^\n]+\|(?:\n|\Z))*")


def pack_lines(text: str, budget: int) -> list[str]:
    """Lines packed up to budget: cut before a heading that would overflow, or after a line that overflows
    unless it stands alone. Nothing is lost: the pieces joined by line ends are the text."""
    if len(text) <= budget:
        return [text]
    out: list[list[str]] = [[]]
    size = 0
    for line in text.split("\n"):
        cost = len(line) + 1
        if out[-1] and line.startswith("#") and size + cost > budget:
            out.append([])
            size = 0
        out[-1].append(line)
        size += cost
        if size > budget and len(out[-1]) > 1:
            out.append([])
            size = 0
    return ["\n".join(piece) for piece in out if piece]


def paragraphs(text: str) -> list[str]:
    """Non-blank paragraphs. Blank lines inside a table don't part it; the text after a table whose line end the
    table took stays with it."""
    spans = [m.span() for m in TABLE.finditer(text)]
    cuts, at = [], 0
    for gap in re.finditer(r"\n\s*\n", _blotted(text, spans)):
        cuts.append((at, gap.start()))
        at = gap.end()
    cuts.append((at, len(text)))
    blots = _blotted(text, spans)
    out = []
    for a, b in cuts:
        inner = blots[a:b]
        left = len(inner) - len(inner.lstrip())
        right = len(inner.rstrip())
        if right > left:
            out.append(text[a + left : a + right])
    return out


def _blotted(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with tables blackened out, so that their line ends neither part nor trim anything."""
    parts, at = [], 0
    for a, b in spans:
        parts += [text[at:a], "x" * (b - a)]
        at = b
    return "".join([*parts, text[at:]])


def pack_paragraphs(text: str, budget: int) -> list[str]:
    """Paragraphs packed in order while a piece stays within budget; a longer paragraph is a piece of its own."""
    out: list[list[str]] = []
    size = 0
    for p in paragraphs(text):
        if out and size + 2 + len(p) <= budget:
            out[-1].append(p)
            size += 2 + len(p)
        else:
            out.append([p])
            size = len(p)
    return ["\n\n".join(piece) for piece in out]
