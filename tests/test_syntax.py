import pytest

from driftloom.syntax.grammars import failure

EARLY = [
    "1 = 2;", "f() = 1;", "a?.b = 1;", "++a++;", "({a=1});", "break;", "continue;", "yield 1;", "super();", "function f(a, a) {}", "for (f() of x) {}", "a: { function g() { break a } }", "[f()] = x", "(a, b) = 1",
    "eval = 1", "a()++", "--f()", "if (x) break",
]
FINE = [
    "({a=1} = x);", "[a, {b: c.d = 2, ...e}, ...f] = g", "for ({a} of b) {}", "for (a.b of c) {}", "(a) = 1", "(a.b) = 2", "a[0]++", "++a.b", "a.b().c = 1", "f`x`.y = 1", "l: for(;;) { continue l }", "l: { break l }",
    "switch (a) { case 1: break }", "while (1) { switch (b) { default: continue } }", "function* g() { yield; yield 1; yield* x; const h = () => { } }", "class A extends B { constructor() { super(); (() => super())() } }",
    "this.x = 1", "a.b ??= c", "x = {a, b: 1}", "[a, b] = [b, a]", "({}).x = 1", "for (var i = 0; i < 3; i++) if (i) break", "((a)) = 1", "do { if (x) continue; } while (y)",
    "class B { static { this.x = 1 } *g() { yield 1 } async *h() { yield 2 } }", "o = { *g() { yield 1 }, f() { return 1 } }", "a = async () => { for await (const x of y) { if (x) break } }", "let z = a++ + ++b", "a\n++b", "this.#p++",
    "function f(a, {a: b}, ...c) {}",
]


@pytest.mark.parametrize("text", EARLY)
def test_what_a_module_parser_refuses_early(text):
    assert failure(text, "js") is not None and failure(text, "ts") is None


@pytest.mark.parametrize("text", FINE)
def test_what_looks_like_it_but_is_fine(text):
    assert failure(text, "js") is None and failure(text, "ts") is None


@pytest.mark.parametrize("text", ["a ? (b) : c => d;", "a ? b => (c) : d => e", "x = a ? (b): number => b : c", "a ? (b, c) : d => e", "a ? (x) : (y): number => y"])
def test_arrows_in_conditionals(text):
    assert failure(text, "ts") is None


def test_doubled_labels():
    assert failure("a: a: ;", "js") is not None and failure("a: ; a: ;", "js") is None


@pytest.mark.parametrize("n", [300, 20_000])
def test_deep_nesting_is_decided(n):
    assert failure("x = " + "(" * n + "1;", "ts") == 5 + n and failure("x = " + "(" * n + "1" + ")" * n, "js") is None
    assert failure("[" * n, "json") == n and failure("[" * n + "]" * n, "json") is None
