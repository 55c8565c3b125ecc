"""Detectors and state changes on hand-built tables."""

from pyspark.sql import functions as F

from driftloom.operators import states as S

B = "repo string, sectionId string, blockId string, body string, rendered boolean, language string, staleSince string, staleReason string, staleFacets array<string>, fingerprint string, depDocs string"
SEC = "repo string, sectionId string, owner string, path string, heading string, ord int, status string, depDocs string, memberDocs string"


def blocks(spark, rows):
    base = {"repo": "r", "body": "text", "rendered": True, "language": None, "staleSince": None, "staleReason": None, "staleFacets": None, "fingerprint": None, "depDocs": None}
    names = [c.split()[0] for c in B.split(", ")]
    return spark.createDataFrame([tuple((base | x)[n] for n in names) for x in rows], B)


def sections(spark, rows):
    base = {"repo": "r", "heading": "H", "ord": 0, "status": "normal", "depDocs": None, "memberDocs": None}
    names = [c.split()[0] for c in SEC.split(", ")]
    return spark.createDataFrame([tuple((base | x)[n] for n in names) for x in rows], SEC)


def keys(df):
    return sorted((r.sectionId, r.blockId, tuple(r.facets)) for r in df.collect())


def now(spark, rows):
    return spark.createDataFrame([("r", *x) for x in rows], "repo string, sectionId string, blockId string, current string, legacy string")


def test_language_drift(spark):
    b = blocks(spark, [{"sectionId": s, "blockId": "purpose", **x} for s, x in {"a": {"language": "ru"}, "b": {}, "c": {"language": "en"}, "d": {"language": "ru", "staleSince": "t"}, "e": {"language": "ru", "body": " \n"}}.items()])
    assert keys(S.language_drift(b, "en")) == [("a", "purpose", ("language",))] and S.language_drift(b, None).count() == 0


def test_code_drift_and_unwritten(spark):
    b = blocks(spark, [
        {"sectionId": "a", "blockId": "invariants", "fingerprint": "signature=1,body=2"}, {"sectionId": "b", "blockId": "invariants"}, {"sectionId": "c", "blockId": "limitations", "fingerprint": "body=9"},
        {"sectionId": "d", "blockId": "limitations", "fingerprint": "other=1"}, {"sectionId": "e", "blockId": "purpose", "body": "", "fingerprint": "signature=0"}, {"sectionId": "f", "blockId": "purpose", "body": ""},
        {"sectionId": "g", "blockId": "purpose", "body": "", "fingerprint": "signature=1,placement=1"}, {"sectionId": "h", "blockId": "purpose", "body": "", "staleSince": "t"},
    ])
    cur = now(spark, [("a", "invariants", "signature=1,body=3", "x"), ("b", "invariants", "signature=1,body=3", "x"), ("c", "limitations", "body=8", "9"), ("d", "limitations", "body=3", "x"), *[(s, "purpose", "signature=1,placement=1", "x") for s in "efgh"]])
    assert keys(S.code_drift(b, cur)) == [("a", "invariants", ("body",)), ("d", "limitations", ("body",))]
    assert keys(S.unwritten(b, cur)) == [("e", "purpose", ("signature",)), ("f", "purpose", ("signature", "placement"))]


def chain(spark, purpose):
    s = sections(spark, [{"sectionId": f"symbol:{n}.ts#{n}Fn", "owner": f"symbol:{n}.ts#{n}Fn", "path": f"{n}.ts", "heading": n} for n in ("leaf", "middle", "root")])
    b = blocks(spark, [
        {"sectionId": "symbol:middle.ts#middleFn", "blockId": "purpose", "body": purpose}, {"sectionId": "symbol:root.ts#rootFn", "blockId": "purpose", "body": "Root."},
        {"sectionId": "symbol:root.ts#rootFn", "blockId": "limitations", "body": "Limited by `middleFn`."}, {"sectionId": "symbol:root.ts#rootFn", "blockId": "workflows", "body": "On its own."},
    ])
    edges = spark.createDataFrame([("r", "root.ts", "middle.ts"), ("r", "middle.ts", "leaf.ts")], "repo string, path string, sourcePath string")
    names = S.mention_names(spark.createDataFrame([("r", f"symbol:{n}.ts#{n}Fn", f"{n}.ts", f"{n}Fn") for n in ("leaf", "middle", "root")], "repo string, id string, path string, name string"))
    return s, b, S.dependency_docs(edges, s, b), names


def test_dependency_cascade(spark):
    s, b, docs, names = chain(spark, "Adds one.")
    written, stamped = S.record_dependencies(s, b, docs, names, s)
    assert S.dependency_drift(written, stamped, docs, names).count() == 0
    moved = chain(spark, "Adds two.")[2]
    assert keys(S.dependency_drift(written, stamped, moved, names)) == [("symbol:root.ts#rootFn", "limitations", ("depDocs",))]
    # blocks without a stamp of their own follow the whole file; propagating blocks never do
    assert [k[1] for k in keys(S.dependency_drift(written, b, moved, names))] == ["limitations", "workflows"]
    # stamps are given later only where the section's is still current
    assert S.backfill_dependencies(written, b, moved, names).filter("hit").select("sectionId").distinct().count() == 1
    assert S.backfill_dependencies(written, b, docs, names).filter("hit").count() == 4


def test_caps_of_dependency_docs(spark):
    s = sections(spark, [{"sectionId": f"s{i}", "owner": f"o{i}", "path": "dep.ts", "ord": i} for i in range(3)])
    b = blocks(spark, [{"sectionId": "s0", "blockId": "purpose", "body": "x" * 2000}, {"sectionId": "s1", "blockId": "purpose", "body": "y" * 600}, {"sectionId": "s2", "blockId": "purpose", "body": "z" * 500}, {"sectionId": "s2", "blockId": "limitations", "body": "w"}])
    edges = spark.createDataFrame([("r", "a.ts", "dep.ts")], "repo string, path string, sourcePath string")
    doc = S.dependency_docs(edges, s, b).first().doc
    assert "xxx" in doc and "yyy" not in doc and "zzz" in doc and "w" not in doc.replace("rows", "")


def test_mentions(spark):
    cases = [
        ("See src/a/cost.ts.", True), ("Uses `buildPrice`.", True), ("Calls `buildPrice(x)`.", True), ("The buildPrice helper.", True), ("rebuildPrices only", False), ("the cost is high", True), ("nothing", False), ("  ", False),
        ("id", False), (None, False),
    ]
    df = spark.createDataFrame([(i, t, "src/a/cost.ts", ["buildPrice"]) for i, (t, _) in enumerate(cases)], "i int, t string, p string, n array<string>")
    got = [bool(r.m) for r in df.select("i", S.mentions(F.col("t"), F.col("p"), F.col("n")).alias("m")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_members(spark):
    tiers = spark.createDataFrame([("r", "domain:core", "domain", ["file:a.ts"]), ("r", "project:", "project", ["domain:core"])], "repo string, id string, type string, directDeps array<string>")
    s = sections(spark, [{"sectionId": "file:a.ts", "owner": "file:a.ts", "path": "a.ts"}, {"sectionId": "domain:core", "owner": "domain:core", "path": "core"}, {"sectionId": "project:", "owner": "project:", "path": "."}])
    make = lambda t: blocks(spark, [{"sectionId": "file:a.ts", "blockId": "purpose", "body": t}, {"sectionId": "domain:core", "blockId": "purpose"}, {"sectionId": "domain:core", "blockId": "responsibility"}])
    old = S.member_stamps(tiers, s, make("one"))
    stamped = S.stamp_members(s, old, tiers)
    assert S.member_drift(stamped, make("one"), old).count() == 0
    new = S.member_stamps(tiers, s, make("two"))
    assert keys(S.member_drift(stamped, make("two"), new)) == [("domain:core", "purpose", ("memberDocs",)), ("domain:core", "responsibility", ("memberDocs",))]
    assert {tuple(r) for r in S.tier_slugs(S.member_drift(stamped, make("two"), new)).collect()} == {("r", "core")}


def test_tombstones_and_what_lifts_them(spark):
    b = blocks(spark, [{"sectionId": "a", "blockId": "purpose", "fingerprint": "signature=0"}, {"sectionId": "a", "blockId": "workflows"}, {"sectionId": "b", "blockId": "purpose"}])
    stale = spark.createDataFrame([("r", "a", "purpose", "facet_changed", ["signature"]), ("r", "a", "workflows", "facet_changed", ["body", "deps"]), ("r", "z", "purpose", "owned_entity_deleted", ["owned"])], "repo string, sectionId string, blockId string, drift string, facets array<string>")
    t = S.apply_tombstones(b, stale, F.lit("now"))
    assert sorted((r.sectionId, r.blockId, r.staleReason) for r in t.filter("hit").collect()) == [("a", "purpose", "signature_changed"), ("a", "workflows", "code_changed")]
    t = t.drop("hit")
    s = sections(spark, [{"sectionId": "a", "owner": "x", "path": "p"}, {"sectionId": "b", "owner": "y", "path": "p", "status": "review_needed"}])
    assert {r.sectionId: r.status for r in S.section_status(s, t).collect()} == {"a": "stale", "b": "review_needed"}
    assert {r.sectionId: r.status for r in S.section_status(s, t, written=True).collect()} == {"a": "stale", "b": "normal"}
    cur = now(spark, [("a", "purpose", "signature=1", "l"), ("b", "purpose", "signature=2", "l")])
    kept = S.restore_kept(t, b, cur)
    assert sorted((r.sectionId, r.blockId, r.staleSince, r.fingerprint) for r in kept.filter("hit").collect()) == [("a", "purpose", None, "signature=1"), ("a", "workflows", None, None)]
    gone = S.tombstoned(t, s, spark.createDataFrame([("r", "y")], "repo string, id string"))
    assert {(r.blockId, r.drift) for r in gone.collect()} == {("purpose", "owned_entity_deleted"), ("workflows", "owned_entity_deleted")}
    blank = blocks(spark, [{"sectionId": "a", "blockId": "purpose", "body": " "}, {"sectionId": "b", "blockId": "purpose"}])
    assert [(r.sectionId, r.fingerprint) for r in S.stamp_declined(blank, blank, cur).filter("hit").collect()] == [("a", "signature=1")]


def test_render_decision(spark):
    sc = "struct<informativeness:double,novelty:double,specificity:double>"
    rows = [("purpose", "t", 0.1, "s"), ("workflows", "t", 0.4, None), ("limitations", "t", 0.5, None), ("invariants", " ", 0.9, "s"), ("dependencies", "t", None, None), ("changeGuide", "t", 0.4, None)]
    b = blocks(spark, [{"sectionId": "a", "blockId": k, "body": t, "staleSince": x} for k, t, _, x in rows])
    score = spark.createDataFrame([(k, s) for k, _, s, _ in rows], "blockId string, x double")
    b = b.join(score, "blockId").withColumn("scores", F.when(F.col("x").isNotNull(), F.struct(F.col("x").alias("informativeness"), F.lit(1.0).alias("novelty"), F.lit(1.0).alias("specificity"))).cast(sc))
    got = S.render_decision(b, 0.5, {"changeGuide": 0.3})
    assert {r.blockId: r.rendered for r in got.collect()} == {"purpose": True, "workflows": False, "limitations": True, "invariants": False, "dependencies": True, "changeGuide": True}
    assert {r.blockId: r.staleSince for r in got.collect() if r.blockId in ("purpose", "invariants")} == {"purpose": "s", "invariants": None}
    assert {(r.blockId, r.threshold) for r in S.filtered_blocks(got, 0.5).collect()} == {("workflows", 0.5), ("invariants", 0.5)}


def test_scope_and_targets(spark):
    s = sections(spark, [{"sectionId": x, "owner": f"file:{p}", "path": p if x != "c" else None} for x, p in (("a", "src/x.ts"), ("b", "src/deep/y.ts"), ("c", "srcs/z.ts"))])
    pick = lambda *a: sorted(r.sectionId for r in S.in_scope(s, *a).collect())
    assert pick([], [], []) == ["a", "b", "c"] and pick([], [], ["src"]) == ["a", "b"] and pick(["c"], ["src/x.ts"], []) == ["a", "c"] and pick([], ["srcs/z.ts"], []) == ["c"]
    t = spark.createDataFrame([("r", "kept", ["purpose", "workflows"]), ("r", "emptied", ["workflows"])], "repo string, sectionId string, blocks array<string>")
    ids = spark.createDataFrame([("r", x) for x in ("kept", "emptied", "forced")], "repo string, sectionId string")
    got = S.narrow_targets(t, ids, ["purpose", "responsibility"])
    assert {r.sectionId: r.blocks for r in got.collect()} == {"kept": ["purpose"], "forced": ["purpose", "responsibility"]}


def test_deleted_keys_stay_as_tombstones(spark):
    from driftloom.streaming.change_feed import apply_changes, live

    make = lambda rows: spark.createDataFrame(rows, "k string, at int, gone boolean")
    state = apply_changes(None, make([("a", 1, None), ("b", 1, False)]), ["k"], ["at"], "gone")
    state = apply_changes(state, make([("a", 3, True)]), ["k"], ["at"], "gone")
    late = apply_changes(state, make([("a", 2, False)]), ["k"], ["at"], "gone")
    assert {(r.k, r.at, r.gone) for r in late.collect()} == {("a", 3, True), ("b", 1, False)} and [r.k for r in live(late, "gone").collect()] == ["b"]
