import math

import pytest
from pyspark.sql import functions as F

from driftloom.operators import extract as X
from driftloom.syntax.extract import extract

SRC = '''import { readFile as rf, type Stats } from "node:fs/promises";
import def, * as ns from "./lib.js";
import type { T } from './t.js';
export function price(a: number, b = 2): number { const x = a + b; if (x > 3) { return ns.calc(x); } return def(x, "literal one"); }
export const load = async (p: string) => { await rf(p); };
export const short = x => x * 2;
export const k = 3;
export class Shop<U> extends Base<U> { private n = 1; constructor() { super(); this.n = 2; } add(i: T): void { this.items.push(i); } get v() { return 1; } static async find(q: string) { return query(q); } }
function local() { for (const y of z) { y(); } }
export { local as renamed, load };
export default function () { throw new Error("some failure"); }
export * from './other.js';
type Q = 'notaliteral';
const o = { kind: "property", list: ["item0", "it"] };
'''


def test_entities_and_measures():
    e = {x["id"]: x for x in extract(SRC, "ts", "src/a.ts")["entities"]}
    at = lambda n: e["symbol:src/a.ts#" + n]
    assert list(e) == ["file:src/a.ts", *["symbol:src/a.ts#" + n for n in ("price", "load", "short", "Shop", "Shop.add", "Shop.find", "renamed", "default")]]
    assert [at(n)["signature"] for n in ("price", "short", "Shop", "Shop.add", "renamed")] == ["price(a: number, b = 2): number", "short(x)", "class Shop extends Base<U>", "Shop.add(i: T): void", "renamed()"]
    assert [at(n)["n_statements"] for n in ("price", "load", "short", "Shop", "renamed", "default")] == [4, 1, 0, 2, 2, 1]
    assert [at(n)["side_effects"] for n in ("price", "load", "Shop.find", "renamed")] == [False, True, True, False]
    assert SRC[at("Shop.add")["start_offset"] : at("Shop.add")["end_offset"]] == "add(i: T): void { this.items.push(i); }" and at("price")["start_line"] == 4


def test_imports_calls_and_literals():
    x = extract(SRC, "ts", "src/a.ts")
    got = {(i["local"], i["imported"], i["type_only"], i["external"], i["referenced"], i["target"]) for i in x["imports"]}
    assert got == {("rf", "readFile", False, True, True, None), ("Stats", "Stats", True, True, False, None), ("def", "default", False, False, True, "src/lib.js"), ("ns", "*", False, False, True, "src/lib.js"), ("T", "T", True, False, True, "src/t.js")}
    assert {(c["entity"].split("#")[-1], c["callee"]) for c in x["calls"]} >= {("price", "ns.calc"), ("price", "def"), ("Shop.add", "this.items.push"), ("Shop.find", "query"), ("renamed", "y"), ("load", "rf")}
    assert {(y["value"], y["role"]) for y in x["literals"]} == {("literal one", "Arguments[1]"), ("some failure", "Arguments[0]"), ("property", "Property"), ("item0", "ArrayLiteral")}


@pytest.mark.parametrize("text", ["", "// only", "export const a = 1", "let x = `a${`b${c()}`}`", "export default class extends A { m() {} }", "export function f( {", "#!/x\nexport async function* g() { yield 1 }"])
def test_odd_files(text):
    x = extract(text, "ts", "a.ts")
    assert x["entities"][0]["id"] == "file:a.ts" and x["parsed"] == ("f( {" not in text)


FILES = [
    (1, "r", "src/leaf.ts", "export function leafFn(n: number) { return n + 1 }"), (2, "r", "src/middle.ts", "import { leafFn } from './leaf.js';\nexport function middleFn(n: number) { return leafFn(n) }"),
    (3, "r", "src/root.ts", "import * as m from './middle';\nimport { gone } from './middle.js';\nimport x from 'node:fs';\nexport const rootFn = (n: number) => { gone(); return m.middleFn(n) }\nexport function other() { return rootFn(1) }"),
    (4, "s", "src/leaf.ts", "import { nope } from './none.js'; nope()"), (5, "r", None, "let a"), (6, "r", "b.json", "{}"), (7, "r", "n.ts", None),
]


def test_edges_and_roles(spark):
    files = spark.createDataFrame(FILES, "file_id long, repo string, path string, source string").withColumn("refs", F.lit(1))
    e = X.extract_files(files)
    assert {(r.file_id, r.parsed) for r in e.collect()} == {(1, True), (2, True), (3, True), (4, True)}
    edges = X.references(e)
    got = {(r.src.split("#")[-1], r.dst.split("#")[-1]) for r in edges.filter("src LIKE 'symbol:%'").collect()}
    assert got == {("middleFn", "leafFn"), ("rootFn", "middleFn"), ("rootFn", "file:src/middle.ts"), ("other", "rootFn")}
    m = {r.id.split("#")[-1]: r for r in X.metrics(e, edges).filter("repo = 'r'").collect()}
    assert m["leafFn"].in_degree == 2 and m["other"].in_degree == 0 and m["rootFn"].n_statements == 2
    assert math.isclose(m["other"].weight, round(math.log(3), 6)) and m["other"].role == "short_page" and m["file:src/leaf.ts"].role == "one_line" and m["file:src/root.ts"].role == "short_page"
    b = {r.id.split("#")[-1]: r for r in X.block_inclusion(X.metrics(e, edges), F.lit(False)).collect()}
    assert b["other"].allowed == ["purpose", "responsibility", "invariants", "limitations"] and b["other"].skipped == ["dependencies", "workflows", "changeGuide"]
    assert "workflows" in b["leafFn"].allowed
    assert X.extract_files(files.limit(0)).count() == 0 and X.references(X.extract_files(files.limit(0))).count() == 0


def test_roles_by_weight(spark):
    df = spark.createDataFrame([(0, 0, False), (1, 0, False), (18, 0, False), (0, 0, True)], "s int, d int, e boolean")
    assert [r[0] for r in df.select(X.role(X.weight(F.col("s"), F.col("d"), F.col("e")))).collect()] == ["one_line", "short_page", "short_page", "full_page"]
