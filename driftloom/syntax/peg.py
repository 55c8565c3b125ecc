"""Packrat parsing-expression grammars, compiled from their notation to one Python function per parser.

Notation, one rule after another:

    Rule <- A 'token' / !B C* (D / E)?      choice is ordered; ?, *, +, !, & and groups as usual
    'token'                                 a token with that text that is not a string
    IDENT NAME NUMBER STRING TEMPLATE REGEX PRIVATE EOF    token classes of the lexer
    GT                                      one '>' even where the lexer sees '>>'
    NL, NONL                                a line end before the next token, or none
    IN_FUNCTION IN_LOOP IN_BREAK IN_GENERATOR IN_CONSTRUCTOR    inside the body of one; IN_BREAK also inside a switch
    LABEL                                   an identifier that labels a statement around this one

Rules with these names carry what is around a statement: FunctionBody, ArrowBody, GeneratorBody and ConstructorBody begin a
function, LoopBody and SwitchBody what break and continue leave, Labelled a label, which must not repeat one around it.  The
names in a DistinctParameters list of plain identifiers must differ.

Rules whose name ends in an underscore are not memoized (they are cheap); every other rule is remembered per position,
so that parsing takes time linear in the text for a given grammar.  A choice looks at the next token first and skips
alternatives that cannot begin with it.

The lexer works on demand from a character position, because whether a slash begins a regular expression and a brace
ends a template substitution depends on the rule that asks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Words that are no identifiers in module code; fixed values.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await let static implements interface package private protected public".split()
)

_SKIP = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*[\s\S]*?\*/)+")
_ID = r"(?:[^\W\d]|[$‌‍]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$‌‍]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*"
_TOKEN = re.compile(
    rf"(?P<i>{_ID})"
    r"|(?P<n>(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$]))"
    r"|(?P<s>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<t>`)"
    rf"|(?P<h>\#{_ID})"
    r"|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/(?![*/])=?|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*%&|^!~?:=.@])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r  ]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/(?P<flags>[\w$]*)")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_FLAGS = frozenset("dgimsuvy")

_CLASSES = {"IDENT": "i", "NAME": "i", "NUMBER": "n", "STRING": "s", "TEMPLATE": "t", "PRIVATE": "h", "EOF": "e", "REGEX": "/"}
#: Marks that look at what is around, with their place in the context.
_AROUND = {"IN_FUNCTION": 0, "IN_LOOP": 1, "IN_BREAK": 2, "IN_GENERATOR": 3, "IN_CONSTRUCTOR": 4}
_MARKS = {"NL", "NONL", "GT", "LABEL", *_AROUND}
#: What a rule of that name sets for its inside: the values of the context, None to leave one as it is.
_SETS = {
    "FunctionBody": (1, 0, 0, 0, 0), "GeneratorBody": (1, 0, 0, 1, 0), "ConstructorBody": (1, 0, 0, 0, 1), "ArrowBody": (1, 0, 0, None, None), "LoopBody": (None, 1, 1, None, None),
    "SwitchBody": (None, None, 1, None, None),
}

# ---------------------------------------------------------------- notation to tree

_LEX = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:(?P<rule>[A-Za-z_]+)\s*<-|(?P<name>[A-Za-z_]+)|'(?P<lit>[^']+)'|(?P<op>[/()?*+!&]))")


def read_grammar(text: str) -> dict[str, tuple]:
    """Rules by name, as nested tuples."""
    items, at, text = [], 0, text.strip() + "\n"
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        items.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    pos, rules = 0, {}

    def choice() -> tuple:
        nonlocal pos
        alts = [sequence()]
        while pos < len(items) and items[pos] == ("op", "/"):
            pos += 1
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else ("or", *alts)

    def sequence() -> tuple:
        nonlocal pos
        parts = []
        while pos < len(items) and items[pos][0] != "rule" and items[pos] not in (("op", "/"), ("op", ")")):
            parts.append(prefixed())
        return parts[0] if len(parts) == 1 else ("seq", *parts)

    def prefixed() -> tuple:
        nonlocal pos
        if items[pos] in (("op", "!"), ("op", "&")):
            op = items[pos][1]
            pos += 1
            return ("not" if op == "!" else "and", prefixed())
        kind, value = items[pos]
        pos += 1
        if (kind, value) == ("op", "("):
            e = choice()
            pos += 1
        elif kind == "lit":
            e = ("lit", value)
        else:
            e = ("ref", value)
        while pos < len(items) and items[pos] in (("op", "?"), ("op", "*"), ("op", "+")):
            e = ({"?": "opt", "*": "star", "+": "plus"}[items[pos][1]], e)
            pos += 1
        return e

    while pos < len(items):
        name = items[pos][1]
        pos += 1
        rules[name] = choice()
    return rules


# ---------------------------------------------------------------- tree to Python


class _Compiler:
    def __init__(self, rules: dict[str, tuple]):
        self.rules, self.n, self.firsts = rules, 0, {}

    def var(self) -> str:
        self.n += 1
        return f"x{self.n}"

    def first(self, e: tuple, seen: frozenset = frozenset()) -> tuple[frozenset, frozenset, bool] | None:
        """(token texts, token classes, may match nothing) that an expression can begin with; None if unknown."""
        op = e[0]
        if op == "lit":
            return frozenset([e[1]]), frozenset(), False
        if op == "ref":
            n = e[1]
            if n == "GT":
                return frozenset([">", ">>", ">>>", ">=", ">>=", ">>>="]), frozenset(), False
            if n == "REGEX":
                return frozenset(["/", "/="]), frozenset(), False
            if n in _CLASSES:
                return frozenset(), frozenset(_CLASSES[n]), False
            if n == "LABEL":
                return frozenset(), frozenset("i"), False
            if n in _MARKS:
                return frozenset(), frozenset(), True
            if n in self.firsts:
                return self.firsts[n]
            if n in seen:
                return None
            f = self.first(self.rules[n], seen | {n})
            if f is not None:
                self.firsts[n] = f
            return f
        if op in ("not", "and"):
            return frozenset(), frozenset(), True
        if op in ("opt", "star"):
            f = self.first(e[1], seen)
            return None if f is None else (f[0], f[1], True)
        if op == "plus":
            return self.first(e[1], seen)
        if op == "or":
            fs = [self.first(x, seen) for x in e[1:]]
            if any(f is None for f in fs):
                return None
            return frozenset().union(*(f[0] for f in fs)), frozenset().union(*(f[1] for f in fs)), any(f[2] for f in fs)
        texts, classes = frozenset(), frozenset()
        for x in e[1:]:
            f = self.first(x, seen)
            if f is None:
                return None
            texts, classes = texts | f[0], classes | f[1]
            if not f[2]:
                return texts, classes, False
        return texts, classes, True

    def gen(self, e: tuple, src: str, out: str, pad: str) -> list[str]:
        op = e[0]
        get = f"t = T.get({src}) or tok({src})"
        if op == "lit":
            return [pad + get, f"{pad}{out} = t[3] if t[1] == {e[1]!r} else -1"]
        if op == "ref":
            n = e[1]
            if n == "NL":
                return [pad + get, f"{pad}{out} = {src} if t[4] else -1"]
            if n == "NONL":
                return [pad + get, f"{pad}{out} = -1 if t[4] else {src}"]
            if n in _AROUND:
                return [f"{pad}{out} = {src} if around[{_AROUND[n]}] else -1"]
            if n == "LABEL":
                return [pad + get, f"{pad}{out} = t[3] if t[0] == 'i' and t[1] in labels else -1"]
            if n == "GT":
                return [pad + get, f"{pad}{out} = t[2] + 1 if t[1] and t[1][0] == '>' else -1"]
            if n == "IDENT":
                return [pad + get, f"{pad}{out} = t[3] if t[0] == 'i' and t[1] not in RESERVED else -1"]
            if n == "TEMPLATE":
                return [pad + get, f"{pad}{out} = template(t[3]) if t[0] == 't' else -1"]
            if n == "REGEX":
                return [f"{pad}{out} = regex({src})"]
            if n in _CLASSES:
                return [pad + get, f"{pad}{out} = t[3] if t[0] == {_CLASSES[n]!r} else -1"]
            return [f"{pad}{out} = R_{n}({src})"]
        if op == "seq":
            lines, cur = [], src
            for k, x in enumerate(e[1:]):
                nxt = out if k == len(e) - 2 else self.var()
                lines += self.gen(x, cur, nxt, pad)
                if k < len(e) - 2:
                    if k == 0 or True:
                        lines.append(f"{pad}if {nxt} < 0: {out} = -1")
                        lines.append(f"{pad}else:")
                        pad += " "
                cur = nxt
            return lines
        if op == "or":
            if all(x[0] == "lit" for x in e[1:]):
                return [pad + get, f"{pad}{out} = t[3] if t[1] in {tuple(x[1] for x in e[1:])!r} else -1"]
            lines = [f"{pad}{out} = -1"]
            fs = [self.first(x) for x in e[1:]]
            if any(f and not f[2] for f in fs):
                lines += [pad + get, f"{pad}v{pad.count(' ')} = t[1]; k{pad.count(' ')} = t[0]"]
            v, kk = f"v{pad.count(' ')}", f"k{pad.count(' ')}"
            for n, (x, f) in enumerate(zip(e[1:], fs)):
                cond = [] if n == 0 else [f"{out} < 0"]
                if f and not f[2]:
                    tests = []
                    if f[0]:
                        tests.append(f"{v} in {self.const(f[0])}")
                    if f[1]:
                        tests.append(f"{kk} in {''.join(sorted(f[1]))!r}")
                    cond.append("(" + " or ".join(tests) + ")")
                if cond:
                    lines.append(f"{pad}if {' and '.join(cond)}:")
                    lines += self.gen(x, src, out, pad + " ")
                else:
                    lines += self.gen(x, src, out, pad)
            return lines
        if op == "opt":
            return [*self.gen(e[1], src, out, pad), f"{pad}if {out} < 0: {out} = {src}"]
        if op in ("star", "plus"):
            tmp, cur = self.var(), self.var()
            lines = []
            if op == "plus":
                lines += self.gen(e[1], src, cur, pad)
                lines.append(f"{pad}if {cur} >= 0:")
                pad += " "
            else:
                lines.append(f"{pad}{cur} = {src}")
            lines.append(f"{pad}while True:")
            lines += self.gen(e[1], cur, tmp, pad + " ")
            lines += [f"{pad} if {tmp} < 0 or {tmp} == {cur}: break", f"{pad} {cur} = {tmp}"]
            pad = pad[:-1] if op == "plus" else pad
            return [*lines, f"{pad}{out} = {cur}"]
        tmp = self.var()
        test = f"-1 if {tmp} >= 0 else {src}" if op == "not" else f"{src} if {tmp} >= 0 else -1"
        return [*self.gen(e[1], src, tmp, pad), f"{pad}{out} = {test}"]

    def const(self, texts: frozenset) -> str:
        key = tuple(sorted(texts))
        return f"F[{self.sets.setdefault(key, len(self.sets))}]" if len(key) > 3 else repr(key)

    def source(self) -> str:
        self.sets: dict[tuple, int] = {}
        body = []
        for name, e in self.rules.items():
            body.append(f" def R_{name}(p):")
            if not name.endswith("_"):
                body += [f"  r = M_{name}.get(p)", "  if r is not None: return r"]
            if name in _SETS:
                body += ["  kept = around[:]", *[f"  around[{k}] = {v}" for k, v in enumerate(_SETS[name]) if v is not None]]
            if name in _SETS and _SETS[name][0]:
                body += ["  outer = labels[:]", "  labels.clear()"]
            if name == "Labelled":
                body += ["  t = T.get(p) or tok(p)", "  if t[1] in labels: return -1", "  labels.append(t[1])"]
            body += self.gen(e, "p", "r", "  ")
            if name == "Labelled":
                body.append("  labels.pop()")
            if name in _SETS and _SETS[name][0]:
                body.append("  labels[:] = outer")
            if name in _SETS:
                body.append("  around[:] = kept")
            if name == "DistinctParameters":
                body.append("  if r >= 0 and repeats(p, r): r = -1")
            if not name.endswith("_"):
                body.append(f"  M_{name}[p] = r")
            body.append("  return r")
        memos = [f" M_{n} = {{}}" for n in self.rules if not n.endswith("_")]
        return "\n".join(["def bind(T, tok, template, regex, repeats, around, labels):", *memos, *body, f" return {{{', '.join(f'{n!r}: R_{n}' for n in self.rules)}}}"])


class Parsed:
    """The rules of one grammar over one text, and how far they have looked."""

    def __init__(self, bind: Callable, text: str, start: int = 0):
        tokens: dict[int, tuple] = {}
        regexes: dict[int, int] = {}
        chunks: dict[int, int] = {}
        n = len(text)
        match, skip = _TOKEN.match, _SKIP.match

        def tok(p: int) -> tuple:
            m = skip(text, p)
            s = m.end() if m else p
            nl = p == start or m is not None and ("\n" in m.group() or "\r" in m.group())
            if s >= n:
                t = ("e", "", n, n, True)
            else:
                m = match(text, s)
                if m is None:
                    t = ("x", None, s, s, nl)
                else:
                    k = m.lastgroup
                    t = (k, m.group() if k in "ip" else None, s, m.end(), nl)
            tokens[p] = t
            return t

        def regex(p: int) -> int:
            r = regexes.get(p)
            if r is None:
                t = tokens.get(p) or tok(p)
                m = _REGEX.match(text, t[2])
                flags = m.group("flags") if m else ""
                r = regexes[p] = m.end() if m and len(set(flags)) == len(flags) and _FLAGS.issuperset(flags) else -1
            return r

        def template(p: int) -> int:
            """From behind the opening mark to behind the closing one."""
            first = p
            if first in chunks:
                return chunks[first]
            r = -1
            while True:
                m = _CHUNK.match(text, p)
                if m is None:
                    break
                if m.group(1) == "`":
                    r = m.end()
                    break
                p = self.rules[self.substitution](m.end())
                if p < 0:
                    break
                t = tokens.get(p) or tok(p)
                if t[1] != "}":
                    break
                p = t[3]
            chunks[first] = r
            return r

        def repeats(p: int, end: int) -> bool:
            """Whether a list of plain identifiers and commas has one twice; other lists are not looked into."""
            seen: set[str] = set()
            while p < end:
                t = tokens.get(p) or tok(p)
                if t[0] not in "ip" or t[0] == "p" and t[1] != "," or t[2] >= end:
                    return False
                if t[0] == "i":
                    if t[1] in seen:
                        return True
                    seen.add(t[1])
                p = t[3]
            return False

        self.text, self.tokens, self.tok = text, tokens, tok
        self.substitution = "Substitution"
        self.template, self.regex, self.grammar = template, regex, bind.grammar
        self.rules = bind(tokens, tok, template, regex, repeats, [0] * len(_AROUND), [])

    def token(self, p: int) -> tuple:
        return self.tokens.get(p) or self.tok(p)

    @property
    def furthest(self) -> int:
        """Where the furthest token that any rule has looked at begins: the failure position of a failed parse."""
        return self.tokens[max(self.tokens)][2] if self.tokens else 0


def compile_grammar(text: str) -> Callable:
    c = _Compiler(read_grammar(text))
    for e in c.rules.values():
        _known(e, c.rules)
    src = c.source()
    space: dict = {"RESERVED": RESERVED, "F": [frozenset(k) for k in c.sets]}
    exec(compile(src, "<grammar>", "exec"), space)  # noqa: S102 - the source is generated from the grammar above
    space["bind"].grammar = c.rules
    return space["bind"]


def _known(e: tuple, rules: dict) -> None:
    if e[0] == "ref" and e[1] not in rules and e[1] not in _CLASSES and e[1] not in _MARKS:
        raise ValueError(f"grammar: no rule {e[1]}")
    for x in e[1:]:
        if isinstance(x, tuple):
            _known(x, rules)
