"""Markdown in and out: links for code spans, and pages for a site."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

_FENCE = re.compile(r"^\s*(```|~~~)")
_SPAN = re.compile(r"`([^`\n]+)`")
_LINK = re.compile(r"\[[^\]]*\]\([^)]*\)")


def linkify(text: str | None, targets: Mapping[str, str]) -> str | None:
    """Code spans that name a target become links to it, outside fences and links, once per line and target."""
    if text is None:
        return None
    out, fenced = [], False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            taken = [m.span() for m in _LINK.finditer(line)]
            seen: set[str] = set()

            def link(m: re.Match, taken=taken, seen=seen) -> str:
                to = targets.get(m.group(1))
                if to is None or to in seen or any(a <= m.start() < b for a, b in taken):
                    return m.group()
                seen.add(to)
                return f"[{m.group()}]({to})"

            line = _SPAN.sub(link, line)
        out.append(line)
    return "\n".join(out)


def site_page(text: str | None) -> str | None:
    """The first top heading becomes the title of the front matter, further ones go down a level; fences stay as they are."""
    if text is None:
        return None
    title, out, fenced = None, [], False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and line.startswith("# "):
            if title is None:
                title = line[2:].strip()
                continue
            line = "#" + line
        out.append(line)
    head = f"---\ntitle: {json.dumps(title, ensure_ascii=False)}\n---\n" if title else ""
    return head + "\n".join(out).lstrip("\n")
