"""Entity ids and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space on either side of a reference, the no-break space and zero-width marks included.
_EDGE = r"(?U)^[\s ​﻿]+|[\s ​﻿]+$"


def strip_blank(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def canonical_path(path: Column) -> Column:
    """Slashes one way and no leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./+)+", "")


def canonical_id(ref: Column) -> Column:
    """Trimmed id; the path of ``file:`` and ``symbol:`` ids in canonical spelling. Null stays null, blank becomes ''."""
    t = strip_blank(ref)
    scheme = F.regexp_extract(t, r"^(file|symbol):", 1)
    path = F.regexp_extract(t, r"(?s)^(?:file|symbol):([^#]*)", 1)
    rest = F.regexp_extract(t, r"(?s)^(?:file|symbol):[^#]*(#.*)$", 1)
    odd = t.rlike(r"^(?:file|symbol):(?:\./|[^#]*\\)")
    return F.when(odd, F.concat(scheme, F.lit(":"), canonical_path(path), rest)).otherwise(t)


def path_of_id(c: Column) -> Column:
    """The source path of a ``file:`` or ``symbol:`` id; '' for every other id."""
    return F.regexp_extract(c, r"^(?:file:|symbol:)([^#]*)", 1)
