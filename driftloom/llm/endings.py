"""Whether a text stops before its end: sentences, lists, tables, fences, quotations and JSON."""

from __future__ import annotations

import json
import re

#: White space, no-break spaces, zero-width marks and the byte order mark.
BLANK = " \t\r\n\x0b\x0c\u00a0\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_STRIP = re.compile(f"^[{BLANK}]+|[{BLANK}]+$")
#: What exporters put behind a cut: an ellipsis, a bracketed notice, or the number of characters left out.
_MARK = re.compile(
    r"(?:\u2026|\.\.\.+|[\[<(\u2039]\s*(?:\u2026|\.\.\.)?\s*(?:cut|cut off|snip(?:ped)?|trunc(?:ated)?|truncated output|continued|more|omitted|abridged|gek\u00fcrzt|abgeschnitten|\u043e\u0431\u0440\u0435\u0437\u0430\u043d\u043e)\s*(?:\u2026|\.\.\.)?\s*[\]>)\u203a]"
    r"|[\[<(]\s*\+?\s*\d+\s*(?:more\s+)?(?:chars?|characters?|bytes?|tokens?|words?|more|\u0441\u0438\u043c\u0432\u043e\u043b\w*|Zeichen)\s*(?:more|omitted|truncated|left)?\s*[\]>)]|\ufffd+)$",
    re.I,
)
_CLOSERS = ")]}\"'\u00bb\u201d\u201c\u2019*_\u203a"
_PAIRS = {")": "(", "]": "[", "}": "{", "\u00bb": "\u00ab", "\u201d": "\u201c\u201e", "\u201c": "\u201e", "\u2019": "\u2018", "\u203a": "\u2039"}
_END = ".!?\u2026\u3002\uff01\uff1f"
#: Abbreviations that a sentence goes on after, fixed values.
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:e\.\s?g|i\.\s?e|z\.\s?B|d\.\s?h|bzw|vgl|ca|cf|vs|approx|incl|Dr|Mr|Mrs|т\.\s?е|т\.\s?к|напр|см)\.$")
_ITEM = re.compile(r"^\s*(?:>\s*)*(?:[-*+\u2022]|\d+[.)])\s+(.*)$", re.S)
_FENCE = re.compile(r"^\s*(?:>\s*)*(```+|~~~+)", re.M)
_BARE = re.compile(r"^(?:`[^`\n]+`|[\w$]+(?:[.#:/\\-]+[\w$]+)*(?:\(\))?)$")
_JSON_START = re.compile(r"^(?:\{\s*(?:\"|\}|$)|\[\s*(?:[\[{\"\]]|-?\d+\s*[,\]]|true|false|null|$))")


def strip(text: str) -> str:
    return _STRIP.sub("", text)


def json_open(text: str) -> bool:
    """Whether the brackets or a string of a JSON text are still open at its end."""
    depth, quoted, i, n = 0, False, 0, len(text)
    closed_at = -1
    for m in re.finditer(r'\\.|["{}\[\]]', text, re.S):
        c = m.group()
        if c[0] == "\\":
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if c in "{[" else -1
            if depth == 0:
                closed_at = m.end()
    return quoted or depth > 0


def sentence_done(line: str) -> bool:
    """Whether a line of prose ends with a complete sentence, bracket, quotation or code span."""
    t = line.rstrip()
    if t.count("`") % 2:
        return False
    closers = ""
    while t and t[-1] in _CLOSERS:
        closers = t[-1] + closers
        t = t[:-1].rstrip()
    if t and t[-1] in _END and not t.endswith(".."):
        return bool(closers) or not _ABBREVIATION.search(t[-12:])
    if closers:
        last = closers[-1]
        if last in _PAIRS:
            return any(o in t for o in _PAIRS[last])
        return last in "\"'*_" and line.count(last) % 2 == 0
    return False


def export_mark(text: str) -> bool:
    """Whether the text ends with what exporters put behind a cut."""
    return _MARK.search(text) is not None


def cut_kind(text: str | None) -> str | None:
    """None for a complete (or null or blank) text, else what was cut: marker, json, fence, code, item, row or sentence.

    Endings that are complete in their own style, but lack terminal punctuation, are ``?item`` and ``?heading``.
    """
    if text is None:
        return None
    t = strip(text)
    if not t:
        return None
    mark = _MARK.search(t)
    if mark and not (mark.group().startswith(("\u2026", ".")) and len(_BARE.findall(t[: mark.start()].rstrip())) == 1 and "`" in t):
        return "marker"
    if _JSON_START.match(t):
        try:
            json.loads(t, strict=False)
            return None
        except ValueError:
            if json_open(t):
                return "json"
            if t[-1] in "}]":
                return None
            if "\n" not in t and not t.startswith("["):
                return "json"
    fences = list(_FENCE.finditer(t))
    if len(fences) % 2 and t.count("```") % 2:
        return "fence"
    if t.rstrip("\"'\u201d\u00bb ").endswith("```") and t.count("```") % 2 == 0:
        return None
    lines = t.split("\n")
    last = lines[-1].strip()
    if fences and _FENCE.match(last) or fences and re.fullmatch(r"(?:>\s*)*(?:```+|~~~+)[\"'\u201d\u00bb]*", last):
        return None
    while last.startswith(">"):
        last = last[1:].lstrip()
    if last.startswith("|"):
        return None if last.endswith("|") and len(last) > 1 else "row"
    if re.match(r"^#{1,6}\s+\S", last) and "\n" in t:
        return "?heading"
    item = _ITEM.match(last)
    if item:
        body = item.group(1).strip()
        if sentence_done(body) or _BARE.match(body) and "`" in body:
            return None
        others = [m.group(1).strip() for m in map(_ITEM.match, lines[:-1]) if m]
        prose = [o for o in others if not _BARE.match(o)]
        if prose and not any(sentence_done(o) for o in prose) and body.count("`") % 2 == 0:
            return "?item"  # a list whose entries carry no final mark
        return "item"
    if re.fullmatch(r"[-*+]|\d+[.)]?", last) and "\n" in t:
        return "item"
    if sentence_done(last):
        return None
    if _BARE.match(t):
        return None
    return "code" if last.count("`") % 2 else "sentence"


def is_cut(text: str | None) -> bool:
    """Cut by its ending alone; the endings marked with a question mark are not."""
    kind = cut_kind(text)
    return kind is not None and kind[0] != "?"
