import json
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.syntax.grammars import cause_of, failure, json_failure
from driftloom.llm.parsing import p5_found, p5_rates, parse_files

sys.setrecursionlimit(60_000)

BOTH = r"""
'use strict';
import a, { b as c, default as d } from "./x.js";
import * as ns from 'y'; import {} from 'z'; import "side"; import data from './d.json' with { type: 'json' };
export * from 'a'; export * as q from 'a'; export { b, c as default } from 'm'; export default class extends (a, b) {}
export const { x, y: [z = 1, ...rest], ...others } = f({ get p() { return 1 }, set p(v) {}, async *[k]() {}, 'q': 1, 2: 3, m, async() {}, get: 1, of });
let re = /[/\]]+(?<n>x)\/*/giu.test(s) ? a / b / c : x /= 2;
label: for (let i = 0, n = 3; i < n; i++) { if (i) continue label; else break }
for (const [k, v] of Object.entries(o)) ; for (var k in o) {} for (;;) { break } for await (const x of y()) {}
async function* g(a, { b } = {}, ...c) { await a; yield* b; for await (const q of c) yield q }
const h = async x => await x, i = (a, b = 2) => ({ a, b }), j = async (a) => { return a }, w = () => /x/;
class A extends B { static #p = 1; static { this.q = 2 } constructor() { super(); super.m() } get x() { return this.#p } static async *m() {} 'lit' = 3; [k] = 4; y; static z = () => 1 }
do x++
while (x < 5) x = `a${`b${c}`}d`; tag`x${1}`; new.target; new Foo; new (foo())(1).bar; a?.b?.[c]?.(d) ?? e; x ||= y **= 2; delete a[b], void 0;
if (a) b; else if (c) { d } else e
switch (x) { case 1: case 2: y(); break; default: z() }
try { throw new Error('x') } catch { } finally { }
var s = "a\
b", t = 'it\'s', big = 1_000n + 0xFFn, f = .5e-3 + 5. + 0b11 + 0o7;
a
++b
import('x').then(m => import.meta.url)
;[1, , 2].map(async ({ x }) => x)
/* end */ // last"""
TS = r"""
import type { X } from './x'; import { type Y, Z } from 'z'; import fs = require('fs'); export type { X }; export = foo; import type from 'q';
interface A<T extends B = C> extends D<T>, E { readonly a?: string; [k: string]: any; (x: number): void; new (x: string): A; m<T>(this: A, x?: T): x is T; get v(): number; 1?: 2 }
type U = { a: 1 } | 'b' | `c${string}` | -1 | null | typeof x.y | keyof T | readonly string[] | [a: string, b?: number, ...rest: T[]] | (new () => X) | ((a: number, ...b: any[]) => asserts a is string) | A['b'][] | unique symbol;
type M<T> = { readonly [K in keyof T as `x${K & string}`]?: T[K] } & { -readonly [P in Q]-?: R }; type C<T> = T extends (infer U extends string)[] ? U : never;
enum E { A, B = 1 << 2, 'c' = "x" } const enum F { A } declare enum G { X }
declare module 'm' { export function f(): void; const x: number } declare global { interface Window { a: any } } namespace N.M { export const a = 1 } declare function ext(x: string): void; declare let v: number
abstract class K<T> extends L<T> implements I, J<T> { private readonly a: string = 'x'; protected static b?: number; c!: T; constructor(private x: string, public readonly y?: number) { super() } abstract m(): void; get g(): T { return this.a as unknown as T } declare d: string; override n<T>(a: T): asserts a {} [k: string]: any; static async *s?(): any {} }
function over(a: string): void; function over(a: number): void; function over(this: any, a: any, b?: string, ...c: any[]): a is string { return <any>a! }
const f = <T,>(x: T): T => x, g = async <T>(x: T) => x, h = (x?: number): x is 5 => true; let v2 = f<string>('a') satisfies any; const m = new Map<string, Array<Set<number>>>(); a < b; c > (d);
@dec() @ns.other class D { @prop x = 1; @m() method(@p a: string) {} }
let o = { m<T>(x: T): void {}, async f(): Promise<void> {} }, x = y as const, t = a ? (b) : c, big: Record<string, any> = {}; let fn: (a: string) => void = (a) => {}; export default abstract class Q {} export abstract class R {}
for (const x of y as any[]) { x!.y![0]!() } type T1 = import('x').Y<string>; let u: typeof import('x'); if (a < b && c > d) {} declare const w: unique symbol"""


def test_valid_scripts():
    for lang in ("js", "ts"):
        assert failure(BOTH.replace("new.target;", ""), lang) is None, BOTH[failure(BOTH, lang) :][:80]
    f = failure(TS, "ts")
    assert f is None, TS[max(0, f - 40) : f] + "<<>>" + TS[f : f + 60]


@pytest.mark.parametrize("text", ["", "  \n", "// only a comment", "﻿export {}", "#!/usr/bin/env node\nlet a = 1", "let a = 1\r\nlet b = `\r\n`\r\n", "a\n/b/g", "x = {};\n/re/.test(y)", "let of = 1; let async = 2; async = of", "var get, set; get = set", "a = b\n(c)"])
def test_odd_but_valid(text):
    assert failure(text, "js") is None and failure(text, "ts") is None


BAD = ["let = 1; const = 4;", "f(1, 2", "if (x( {", "a b", "class { x }", "`${", '"abc', "/* open", "return 1", "x = [1, 2", "let x = ;", "<<<<<<< a\nlet x\n=======\n>>>>>>> b", "import { a from 'b'", "export { a", "function (", "for (const x of) {}", "{ import a from 'b' }", "const x;", "a => { ", "3in x", "x = /a", "let a = 'x\ny'", "} ", "def f(x):\n  pass", "<!DOCTYPE html>", "# Title", "switch (a) { foo }", "{\"name\": \"x\", \"y\": 1}"]


@pytest.mark.parametrize("text", BAD)
def test_invalid(text):
    assert failure(text, "js") is not None and failure(text, "ts") is not None


@pytest.mark.parametrize("text", ["let a: string", "interface X {}", "type A = 1", "function f(a: any) {}", "enum E {}", "import type { X } from 'y'", "let x = y as any", "class A { private x = 1 }", "f<string>(x) as y", "x!"])
def test_types_are_not_ecmascript(text):
    assert failure(text, "js") is not None and failure(text, "ts") is None


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=12), st.booleans())
@settings(max_examples=150, deadline=None)
def test_json_accepts_json(value, indent):
    assert json_failure(json.dumps(value, indent=2 if indent else None)) is None


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", "{'a': 1}", '{"a": 1,}', "NaN", "01", "1.", "+1", '"a\tb"', '"\\x"', "// c\n{}", "{} {}", "﻿{}", "[1 2]", "nul", '{"a" 1}', "-"])
def test_json_refuses_the_rest(text):
    assert json_failure(text) is not None


def test_position_and_cause():
    t = "let a = 1;\nfoo({ b: );\n"
    assert failure(t, "js") == t.index(")") and cause_of(t, failure(t, "js")) == "syntax"
    c = "let a;\n<<<<<<< ours\nlet b;\n=======\nlet c;\n>>>>>>> theirs\n"
    assert cause_of(c, failure(c, "ts")) == "conflict"
    e = "function f() {\n  if (x) {\n"
    assert cause_of(e, failure(e, "ts")) == "end"
    assert failure("`\n<<<<<<< ours\n=======\n`", "ts") is None


def test_time_is_linear():
    deep = "x = " + "(" * 300 + "1" + ")" * 300
    assert failure(deep, "js") is None
    assert failure("f(" * 200 + ")" * 199, "ts") is not None


def test_operator(spark, data):
    rows = [(1, "r", "a.ts", "let a: any = 1", 0), (1, "r", "a.ts", "let a: any = 1", 0), (2, "r", "b.js", None, 0), (3, None, "c.json", "", 0), (4, "r", "d.JS", "let", 0), (5, "r", "e.py", "def", 0), (6, "r", None, "x", 0)]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, source string, line int")
    got = sorted((r.file_id, r.failed_at is not None) for r in parse_files(df).collect())
    assert got == [(1, False), (1, False), (3, True), (4, True)]
    assert parse_files(df.limit(0)).count() == 0
    assert p5_found(spark, data).count() == p5_rates(spark, data).groupBy().sum("n_failed").first()[0]
