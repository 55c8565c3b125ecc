"""Trees of parsed files, read back from what the parser remembers.

A packrat parser keeps the end of every rule at every position, so a tree needs no second parse: the grammar is followed
again and each rule that is met is looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

from driftloom.syntax.peg import _AROUND, _CLASSES, RESERVED, Parsed


class Node:
    """A rule over text[start:end], with its tokens and rules in order; a token has no rule and no children."""

    __slots__ = ("rule", "start", "end", "children")

    def __init__(self, rule: str, start: int, end: int, children: list[Node]):
        self.rule, self.start, self.end, self.children = rule, start, end, children

    def all(self, *rules: str) -> list[Node]:
        return [c for c in self.children if c.rule in rules]

    def first(self, *rules: str) -> Node | None:
        return next((c for c in self.children if c.rule in rules), None)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))


def tree(p: Parsed, rule: str, at: int) -> Node:
    """The tree of `rule` at a position where it has been parsed."""
    out: list[Node] = []
    end = _follow(p, p.grammar[rule], at, out)
    return Node(rule, out[0].start if out else p.token(at)[2], end, out)


def _token(p: Parsed, at: int, ok: bool, out: list[Node]) -> int:
    if not ok:
        return -1
    t = p.token(at)
    if t[0] != "e":
        out.append(Node("", t[2], t[3], []))
    return t[3]


def _follow(p: Parsed, e: tuple, at: int, out: list[Node]) -> int:
    """The end of an expression at a position, -1 where it does not hold; what it consists of is added to `out`."""
    op = e[0]
    if op == "lit":
        return _token(p, at, p.token(at)[1] == e[1], out)
    if op == "ref":
        n = e[1]
        t = p.token(at)
        if n in _AROUND or n == "NL" and t[4] or n == "NONL" and not t[4]:
            return at
        if n in ("NL", "NONL"):
            return -1
        if n == "GT":
            return t[2] + 1 if t[1] and t[1][0] == ">" else -1
        if n == "IDENT":
            return _token(p, at, t[0] == "i" and t[1] not in RESERVED, out)
        if n == "LABEL":
            return _token(p, at, t[0] == "i", out)
        if n in ("TEMPLATE", "REGEX"):
            end = p.regex(at) if n == "REGEX" else p.template(t[3]) if t[0] == "t" else -1
            if end >= 0:
                out.append(Node(n, t[2], end, _substitutions(p, t[3], end) if n == "TEMPLATE" else []))
            return end
        if n in _CLASSES:
            return _token(p, at, t[0] == _CLASSES[n], out)
        end = p.rules[n](at)
        if end > at:
            out.append(tree(p, n, at))
        return end
    if op == "seq":
        mark = len(out)
        for x in e[1:]:
            at = _follow(p, x, at, out)
            if at < 0:
                del out[mark:]
                return -1
        return at
    if op == "or":
        for x in e[1:]:
            end = _follow(p, x, at, out)
            if end >= 0:
                return end
        return -1
    if op in ("not", "and"):
        return at if (_follow(p, e[1], at, []) >= 0) == (op == "and") else -1
    if op == "opt":
        end = _follow(p, e[1], at, out)
        return at if end < 0 else end
    n = 0
    while True:
        end = _follow(p, e[1], at, out)
        if end < 0 or end == at:
            return at if n or op == "star" else end
        at, n = end, n + 1


def _substitutions(p: Parsed, at: int, end: int) -> list[Node]:
    """The expressions inside a template whose text begins at `at`."""
    from driftloom.syntax.peg import _CHUNK

    out: list[Node] = []
    while True:
        m = _CHUNK.match(p.text, at)
        if m is None or m.group(1) == "`" or m.end() > end:
            return out
        out.append(tree(p, "Expression", m.end()))
        at = p.token(p.rules["Expression"](m.end()))[3]
