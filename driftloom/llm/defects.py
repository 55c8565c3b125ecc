"""What makes a response empty, a copy or foreign: exact tests that the pair features are made of."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from driftloom.llm.endings import BLANK, strip
from driftloom.llm.languages import language_named, language_of

DEFECTS = ("empty", "refusal", "copy", "truncated", "other_language")

_NOTHING = re.compile(f"[{BLANK}\"'`\u201c\u201d\u201e\u00ab\u00bb\u2018\u2019\u00ad]+")
_FENCED = re.compile(r"^\s*(?:```|~~~)[\w+-]*\s*\n?(.*?)\n?\s*(?:```|~~~)\s*$", re.S)


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^\s\[\]{},:"]+))')


def _deep_leaves(text: str) -> list[object]:
    """`_leaves` of a text nested too deeply for the json module, with a stack of its own."""
    out: list[object] = []
    stack: list[str] = []
    want, at, text = "value", 0, text.rstrip(" \t\n\r")
    while at < len(text):
        m = _JSON_TOKEN.match(text, at)
        if not m:
            raise ValueError(text[at : at + 20])
        at = m.end()
        mark, string, scalar = m.groups()
        if mark and mark in "[{" and want in ("value", "first"):
            stack.append(mark)
            want = "first" if mark == "[" else "first key"
        elif mark and mark in "]}" and stack and stack[-1] == "[{"["]}".index(mark)] and want in ("next", "first" if mark == "]" else "first key"):
            stack.pop()
            want = "next"
        elif mark == "," and want == "next" and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif mark == ":" and want == "colon":
            want = "value"
        elif string and want in ("key", "first key"):
            json.loads(string)
            want = "colon"
        elif (string or scalar) and want in ("value", "first"):
            out.append(json.loads(string or scalar))
            want = "next"
        else:
            raise ValueError(m.group())
    if stack or want != "next":
        raise ValueError("open at the end")
    return out


def _leaves(text: str) -> list[object]:
    """The values of a JSON text that are no containers, in order; ValueError if it is none."""
    try:
        todo = [json.loads(text)]
    except RecursionError:
        return _deep_leaves(text)
    out = []
    while todo:
        v = todo.pop()
        if isinstance(v, dict | list):
            todo.extend(reversed(v.values() if isinstance(v, dict) else v))
        else:
            out.append(v)
    return out


def _hollow(value: object) -> bool:
    return value is None or isinstance(value, str) and not _NOTHING.sub("", value)


def is_empty(text: str | None) -> bool:
    """Null, or nothing but white space, invisible characters, quotes, empty JSON containers or an empty fence."""
    if text is None:
        return True
    t = strip(text)
    m = _FENCED.match(t)
    if m:
        t = strip(m.group(1))
    if not t or _NOTHING.fullmatch(t):
        return True
    if t[0] in "{[":
        try:
            return all(map(_hollow, _leaves(t)))
        except ValueError:
            return False
    return False


_NOT_LETTERS = re.compile(r"[\W_]+")


def _letters(text: str) -> str:
    return _NOT_LETTERS.sub("", text.casefold())


def copy_lead(user: str | None, response: str | None) -> int | None:
    """How many letters stand before the user message, where the response ends with it but for case, white space and quoting."""
    if not user or not response:
        return None
    a, b = _letters(user[-200:]), _letters(response[-200:])
    n = min(len(a), len(b))
    if n and a[-n:] != b[-n:]:
        return None  # the last letters tell most pairs apart without a pass over whole texts
    u, r = _letters(user), _letters(response)
    return len(r) - len(u) if u and r.endswith(u) else None


def is_copy(user: str | None, response: str | None, lead_in: int = 60) -> bool:
    """The response is the user message with a lead-in of at most `lead_in` letters."""
    lead = copy_lead(user, response)
    return lead is not None and lead <= lead_in


def without_echo(user: str | None, response: str) -> str:
    """The response without a first paragraph that only repeats the beginning of the user message."""
    head, gap, rest = response.partition("\n\n")
    if user and gap and rest.strip():
        h = _letters(head)
        if len(h) >= 12 and _letters(user[: 2 * len(head) + 40]).startswith(h):
            return rest
    return response


_named_once = lru_cache(1024)(language_named)  # system messages repeat


def asked_language(system: str | None, user: str | None) -> str | None:
    """The language the user message names, else the one the system message names, else that of the user message."""
    return language_named(user) or _named_once(system) or language_of(user)
