"""A comment stripper for script sources, aware of strings, templates and regular expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = re.compile(
    r"(?P<comment>//[^\n\r]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<text>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*`?)"
    r"|(?P<regex>/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)|(?P<word>[\w$]+)|(?P<other>[^\s])|(?P<blank>\s+)"
)
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ return typeof case in of delete void throw new do else".split())


def strip_comments(source: str | None) -> str | None:
    """The source without comments; blanks before line ends go, three and more line ends become two. Null stays null."""
    if source is None:
        return None
    out, last, at = [], "(", 0
    while at < len(source):
        m = _PIECE.match(source, at)
        kind = m.lastgroup
        if kind == "regex" and last not in _BEFORE_REGEX:
            out.append("/")  # a division
            last, at = "/", at + 1
            continue
        if kind != "comment":
            out.append(m.group())
            if kind != "blank":
                last = m.group() if kind in ("word", "other") else "x"
        at = m.end()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\r?\n|\Z)", "", "".join(out))).strip()


@F.pandas_udf(T.StringType())
def strip_comments_udf(sources: pd.Series) -> pd.Series:
    return sources.map(strip_comments, na_action="ignore")
