import pytest

from driftloom.llm.endings import cut_kind, is_cut

WHOLE = [
    "It reads files, links etc.", "Callers see it (e.g. the parser).", "It is version 2.", "So it is at scale.",
    None, "", "  \n", "​", "`name`", "Foo.bar()", "A sentence.", "Why?", 'He said "no."', "Done (see `x`)", 'Text. "name …"', "- `a`\n- `b`", "A.\n\n| `a` | 3 |",
    "x\n\n```ts\nf(\n```", '{"a": [1, "}"]}', "[]", "{}", "```json\n{}\n```", "> quoted text.", "Note: [truncated] `x`.", "- one thing.\n- another.", '"Is it?"', "«Да.»", "Ends in code `f()`.",
    "flat ```ts code```",
]
CUT = [
    ("The parser rea", "sentence"), ("The parser reads the", "sentence"), ("A. The `par", "code"), ('{"a": "b', "json"), ('{"a": [1, 2', "json"), ("A. B is [cut]", "marker"), ("A. Bc…", "marker"),
    ("A. B <+12 chars>", "marker"), ("Text bro�", "marker"), ("A.\n- The list", "item"), ("A.\n\n| `a` | 3", "row"), ("A.\n```ts\nlet x", "fence"), ("A.\n\n- ", "item"), ("If it is so,", "sentence"), ("A...", "marker"), ("Order:", "sentence"), ("It reads some files, e.g.", "sentence"), ("Das gilt auch hier, z.B.", "sentence"), ("Он читает файлы, т.е.", "sentence"),
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert cut_kind(text) is None


@pytest.mark.parametrize("text,kind", CUT)
def test_cut(text, kind):
    assert cut_kind(text) == kind


def test_style_is_not_a_cut_by_itself():
    assert cut_kind("- one thing\n- another thing") == "?item" and not is_cut("- one thing\n- another thing")


def test_very_long_texts():
    assert cut_kind("A sentence. " * 200_000) is None
    assert cut_kind('{"a": "' + "x" * 1_000_000) == "json"
