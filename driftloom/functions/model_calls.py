"""Calls to a language model as a table operator: an injected client, retries with feedback, strict answers.

The engine has no client of its own; `call` gets a prompt and returns a text.  An answer that is no JSON object is
asked for again with the fault named, at most `attempts` times; other errors of the client are retried as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_FENCE = re.compile(r"^\s*```[\w-]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
_BAD_ESCAPE = re.compile(r'\\(?!["\\/bfnrtu])')


def parse_object(text: str) -> dict:
    """The JSON object in a text, an outer fence taken off; stray escapes and raw control characters are repaired once."""
    m = _FENCE.match(text)
    body = m.group(1) if m else text
    try:
        value = json.loads(body)
    except ValueError:
        value = json.loads(_BAD_ESCAPE.sub(r"\\\\", body), strict=False)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


def complete(call: Callable[[str], str], prompt: str, attempts: int = 3) -> tuple[str | None, str | None, int]:
    """(answer, error, number of calls)."""
    asked, error = prompt, None
    for k in range(1, attempts + 1):
        try:
            text = call(asked)
        except Exception as e:  # noqa: BLE001 - the client's errors are data here
            error = f"call: {e}"
            continue
        try:
            return json.dumps(parse_object(text), ensure_ascii=False, separators=(",", ":")), None, k
        except ValueError as e:
            error = f"answer: {e}"
            asked = f"{prompt}\n\nThe previous answer could not be used ({e}). Answer with one JSON object."
    return None, error, attempts


def complete_rows(prompts: DataFrame, key: str, call: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """(key, answer, error, n_calls) for a table of (key, prompt)."""
    schema = T.StructType([prompts.schema[key], T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), T.StructField("n_calls", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [complete(call, p or "", attempts) for p in b["prompt"]]
            yield pd.DataFrame({key: b[key], "answer": [g[0] for g in got], "error": [g[1] for g in got], "n_calls": [g[2] for g in got]})

    return prompts.select(key, "prompt").mapInPandas(run, schema)
