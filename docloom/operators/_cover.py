"""Query syntax and cover density for the few chunks that hold a query's words (Clarke, Cormack and Tudhope,
"Relevance ranking for one to three term queries")."""

from __future__ import annotations

import re

_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r'(-?)"([^"]*)"|(\S+)')


def parse_query(text: str) -> list[dict]:
    """Groups that must all hold: {any: alternatives, each a phrase of words; negative}."""
    out: list[dict] = []
    join = False
    for minus, quoted, bare in _PART.findall(text):
        if bare.lower() == "or" and out:
            join = True
            continue
        negative = bool(minus) or (bare.startswith("-") and len(bare) > 1)
        phrase = _WORD.findall((quoted or bare).lower())
        if not phrase:
            continue
        if join and not negative and not out[-1]["negative"]:
            out[-1]["any"].append(phrase)
        else:
            out.append({"any": [phrase], "negative": negative})
        join = False
    return out if any(not g["negative"] for g in out) else []


def _places(phrase: list[str], at: dict[str, list[int]]) -> list[int]:
    sets = [set(at.get(w) or ()) for w in phrase]
    return [p for p in at.get(phrase[0]) or () if all(p + i in s for i, s in enumerate(sets))]


def cover_density(query: list, at: dict[str, list[int]]) -> float | None:
    """Sum over shortest spans that hold every group of 1 / length of the span; null if the chunk doesn't match."""
    marks: list[tuple[int, int, int]] = []
    groups = 0
    for g in query:
        found = [(p, p + len(phrase) - 1) for phrase in g["any"] for p in _places(list(phrase), at)]
        if g["negative"]:
            if found:
                return None
            continue
        if not found:
            return None
        marks += [(a, b, groups) for a, b in found]
        groups += 1
    last: dict[int, int] = {}  # of each group, the latest start of an occurrence that has ended
    total, before = 0.0, -1
    for begin, end, group in sorted(marks, key=lambda m: (m[1], m[0])):
        last[group] = max(last.get(group, -1), begin)
        start = min(last.values())
        if len(last) == groups and start > before:
            total += 1.0 / (end - start + 1)
            before = start
    return total


def density_of(query: list, words: list[str]) -> float | None:
    """cover_density of a chunk's words in their order."""
    wanted = {w for g in query for phrase in g["any"] for w in phrase}
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in wanted:
            at.setdefault(w, []).append(i)
    return cover_density(query, at)
