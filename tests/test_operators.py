"""Operators on small graphs with known answers, each checker with a case that must fail."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators import audits
from tessera.operators import relations as R
from tessera.operators import traverse as T
from tessera.operators import trust as E
from tessera.operators import versions as V
from tessera.sources import io
from tessera.streaming import flows


def edges(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pos long, source string, target string, type string, kind string, level string, confidence double")


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("N:iso", ["Formula"], None), ("N:a", ["Formula"], "d1"), ("N:b", ["Quantity"], "d2"), ("N:c", ["Definition"], "d1")], "id string, labels array<string>, domain string")
    e = edges(spark, [("N:a", "N:b", "has_symbol", "has_symbol", "model_inferred", 0.5), ("N:a", "N:c", "has_symbol", "has_symbol", "by_construction", 0.9), ("N:b", "N:c", "has_quantity", "has_quantity", "by_construction", None)])
    return nodes, e


def counts(df, *conditions):
    return {r.condition: (r.n, r.best) for r in df.collect()}


def test_grades(spark):
    rows = [("e5", "cross_source", "SR", "h1"), ("e4", "rule_checked", "SR", "h1"), ("e3", "source_asserted", "SR", "h1"), ("e2", "rule_checked", "SN", None), ("e1", "model_inferred", "SR", "h1"), ("edrop", "cross_source", "SN2", "h2"), ("ebad", "cross_source", "SN", None), ("e0", "source_asserted", None, None)]
    e = spark.createDataFrame([(r[0], r[1]) for r in rows], "edge string, level string")
    evidence = spark.createDataFrame([(r[0], r[2], r[3], True) for r in rows if r[2]], "edge string, src string, src_hash string, indep boolean")
    registry = spark.createDataFrame([("SR", True, "h1", "in", True), ("SN2", True, "h2", "in", False), ("SN", True, None, "not_in_repo", False)], "src string, known boolean, hash string, repo_status string, redistributable boolean")
    graded = E.graded(e, evidence, registry)
    got = {r.edge: (r.internal, r.public_grade) for r in graded.collect()}
    assert got == {"e5": (5, 5), "e4": (4, 4), "e3": (3, 3), "e2": (2, 2), "e1": (1, 1), "edrop": (5, 2), "ebad": (2, 2), "e0": (1, 1)}
    assert {r.n for r in E.reconciled(graded).collect()} == {0}
    assert {r.rule: r.n for r in E.reconciled(graded.withColumn("public_grade", F.lit(9))).collect()}["out_of_range"] == 8


def test_several_independent_sources_raise_a_grade(spark):
    e = spark.createDataFrame([("x", "source_asserted")], "edge string, level string")
    ev = spark.createDataFrame([("x", "A", "h", True), ("x", "B", "h", True)], "edge string, src string, src_hash string, indep boolean")
    reg = spark.createDataFrame([(s, True, "h", "in", True) for s in "AB"], "src string, known boolean, hash string, repo_status string, redistributable boolean")
    assert E.graded(e, ev, reg).first().internal == 4
    assert E.graded(e, ev.withColumn("indep", F.lit(False)), reg).first().internal == 3


def test_diagnosis(small):
    _, e = small
    near = e.where("source = 'N:a' OR target = 'N:a'")
    verified = expr.level_rank(F.col("level")) >= 3
    got = counts(T.diagnosis(near, {"kinds": F.col("kind") == "__none__", "trust": verified}))
    assert got == {"kinds": (1, True), "trust": (0, False)}
    assert counts(T.diagnosis(near, {"kinds": F.col("kind") == "__none__"})) == {"kinds": (2, True)}
    assert R.trusted(near, "verified").count() == 1


def test_traversal(small):
    nodes, e = small
    seed = nodes.where("id = 'N:a'")
    assert {r.id: r.hop for r in T.ego(e, seed, 1).collect()} == {"N:a": 0, "N:b": 1, "N:c": 1}
    assert [r.path for r in T.paths(e, "N:a", "N:c", 3).collect()] == ["N:a>N:c", "N:a>N:b>N:c"]
    assert [r.id for r in T.isolated(nodes, e).collect()] == ["N:iso"]
    assert {r.component for r in T.components(e).collect()} == {"N:a"}
    kept, inside = T.ego_subgraph(nodes, e, seed, 1, max_nodes=2)
    assert [r.before for r in kept.collect()] == [3, 3] and kept.first().truncated and inside.count() == 1


def test_long_chain_is_one_component(spark):
    chain = edges(spark, [(f"n{k:03d}", f"n{k + 1:03d}", "t", "t", None, None) for k in range(40)])
    assert {r.component for r in T.components(chain).collect()} == {"n000"}


def test_components_however_links_are_dealt(spark):
    rng = random.Random(3)
    # one task takes what is left; stars that contract in turn; too little contracted, so labels are spread
    for n, m, chunk in ((300, 200, 150), (20, 400, 40), (60, 40, 3)):
        links = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        rng.shuffle(links)
        at = {x: x for link in links for x in link}
        for _ in at:
            for a, b in links:
                at[a] = at[b] = min(at[a], at[b])
        e = edges(spark, [(a, b, "t", "t", None, None) for a, b in links] + [("n0", None, "t", "t", None, None)])
        rows = T.components(e.coalesce(1), chunk).collect()
        assert len(rows) == len(at) and {r.id: r.component for r in rows} == at


def test_island_sizes_over_chunks(spark):
    # a large island in all chunks, pairs that lie in one
    e = edges(spark, [(f"o{k}", f"p{k % 40 if k < 400 else k}", "t", "t", None, None) for k in range(430)] + [(f"o{k}", f"p{k + 1}", "t", "t", None, None) for k in range(39)])
    sizes = T.components(e.coalesce(1), 150).groupBy("component").count().groupBy("count").agg(F.count("*").alias("islands"))
    assert {r["count"]: r.islands for r in sizes.collect()} == {440: 1, 2: 30}


def test_components_of_interleaved_copies(spark, monkeypatch):
    written = []
    monkeypatch.setattr(T, "checkpointed", lambda df, f=T.checkpointed: written.append(df.columns) or f(df))
    rng = random.Random(5)
    once = [(k // 4, rng.randrange(60)) for k in range(400)]
    # each row of the table is followed by its copies: a chunk of links in this order holds a little of all copies
    e = edges(spark, [(f"o{c * 100 + o:05d}", f"p{c * 60 + p:05d}", "t", "t", None, None) for o, p in once for c in range(40)])
    rows = T.components(e.coalesce(1), 2_000).collect()
    assert {r.component for r in rows} == {f"o{c * 100:05d}" for c in range(40)} and len(rows) == 40 * (100 + len({p for _, p in once}))
    # no rounds over all links
    assert len(written) <= 5


def test_components_of_ids_in_no_order(spark, monkeypatch):
    hooked = []
    monkeypatch.setattr(T, "_hooked", lambda *of, f=T._hooked: hooked.append(of) or f(*of))
    rng = random.Random(8)
    names = [f"n{k:04d}" for k in range(1_000)]
    rng.shuffle(names)
    # a ring, of which no chunk contracts much
    e = edges(spark, [(names[k], names[(k + 1) % 1_000], "t", "t", None, None) for k in range(1_000)])
    rows = T.components(e.coalesce(1), 20).collect()
    assert len(rows) == 1_000 and {r.component for r in rows} == {"n0000"} and hooked


def test_components_read_the_links_once(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(T, "checkpointed", lambda df, f=T.checkpointed: written.append(df.columns) or f(df))
    rng = random.Random(4)
    e = edges(spark, [(f"o{k // 4}", f"p{rng.randrange(300)}", "t", "t", None, None) for k in range(4_000)])
    assert {r.component for r in T.components(e).collect()} == {"o0"}
    # no rounds over the links: what is written has at most a row for each node of each task
    assert len(written) <= 5


def test_link_candidates_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    rows = [(f"o{k}", f"p{rng.randrange(40)}") for k in range(90) for _ in range(rng.randint(1, 5))]
    graphs = [rows, [(f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}") for _ in range(90)], [(f"a{i}", f"b{j}") for i in range(9) for j in range(9)], [("hub", f"x{k}") for k in range(8)]]
    for pairs in graphs:
        near: dict[str, set] = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want = sorted((-len(near[a] & near[b]), a, b) for a in near for b in near if a < b and b not in near[a] and near[a] & near[b])
        e = edges(spark, [(a, b, "t", "t", None, None) for a, b in pairs])
        for most in (5, 60):
            assert [(-r.common, r.a, r.b) for r in T.link_candidates(e, most).collect()] == want[:most]


def test_lineage_longer_than_twenty_steps(spark):
    ring = [(k, (k + 1) % 23) for k in range(23)]
    rows = spark.createDataFrame(ring + [(100, 3), (101, 100), (5, 200), (200, 201), (300, 301)], "id long, parent long")
    assert sorted(r.id for r in T.on_cycles(rows).collect()) == list(range(23))
    chain = spark.createDataFrame([(k + 1, k) for k in range(22)], "id long, parent long")
    assert T.on_cycles(chain).count() == 0
    assert T.closure(chain).agg(F.max("depth")).first()[0] == 22


def test_empty_graph(small):
    nodes, e = small
    none = e.limit(0)
    assert T.components(none).count() == T.ego(none, nodes.limit(0), 2).count() == T.overview(nodes, none).count() == 0
    assert T.isolated(nodes, none).count() == 4


def test_unknown_trust_is_strict(small):
    assert R.trusted(small[1], "whatever").count() == 0
    assert R.trusted(small[1], "all").count() == 3


def test_missing_confidence(small):
    assert R.confident(small[1], 0.0).count() == 3 and R.confident(small[1], 0.1).count() == 2


def test_edge_ids(spark):
    e = edges(spark, [("a", "b", "t", k, None, None) for k in ("x", "y", "y", "y")])
    assert sorted(r.id for r in R.unique_edge_ids(e).collect()) == ["t|a|b", "t|a|b|y", "t|a|b|y#2", "t|a|b|y#3"]


def test_slices_conserve(spark):
    domains = ["physics.em", "physics.mechanics", "chem.reaction", "chemistry.aq", "math.DG", None]
    nodes = spark.createDataFrame([(f"n{k}", d) for k, d in enumerate(domains)], "id string, domain string")
    e = edges(spark, [("n0", "n1", "t", "t", None, None), ("n0", "n2", "t", "t", None, None), ("n2", "n3", "t", "t", None, None), ("n4", "n5", "t", "t", None, None)])
    rows = {r.slice: r for r in V.slices(nodes, e).collect()}
    assert set(rows) == {"chemistry", "math", "physics", "unclassified"} and rows["unclassified"].nodes == 1
    assert sum(r.nodes for r in rows.values()) == 6 and sum(r.edges for r in rows.values()) == 4
    assert all(r.internal + r.crossing == r.edges for r in rows.values())


def test_scalars(spark):
    row = spark.range(1)
    value = lambda c: row.select(c.alias("v")).first().v
    eras = {"1687": "17 世纪", "1899": "19 世纪", "1900": "1900–1909", "公元 820": "9 世纪", "公元前 300": "公元前 3 世纪", "soon": "暂无"}
    assert {t: value(expr.era(F.lit(t))) for t in eras} == eras
    keys = [value(expr.era_key(F.lit(e))) for e in ("公元前 6 世纪", "公元前 3 世纪", "17 世纪", "1900–1909")]
    assert keys == sorted(keys) and value(expr.era_key(F.lit("暂无"))) is None
    assert value(expr.pick_type(F.array(F.lit("Formula"), F.lit("Theorem")))) == "Theorem"
    assert value(expr.pick_type(F.array().cast("array<string>"))) == "Unknown"
    assert value(expr.token_line(F.lit("Maxwell–Boltzmann’s law (ideal)"))) == "maxwellboltzmann law"
    assert value(expr.has_symbol(F.lit(""), F.lit(None).cast("array<string>"), F.lit("x"))) is None
    assert value(E.atoms(F.lit("C6H12O6"))) == "C6 H12 O6"


def test_delta(spark):
    m = "id string, props map<string,string>"
    nodes = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"x": "1"}), ("c", None)], m)
    old = spark.createDataFrame([("a", "b", "t", {"k": "1"}), ("a", "c", "t", None)], "source string, target string, type string, props map<string,string>")
    ups = spark.createDataFrame([("a", {"x": "9"}, ["y"]), ("d", {"z": "1"}, None)], m + ", props_drop array<string>")
    new = spark.createDataFrame([("a", "b", "t", {"k": "2"}), ("a", "gone", "t", None), ("a", "d", "u", None)], old.schema)
    n, e = V.applied(nodes, old, spark.createDataFrame([("c",)], "id string"), ups, old.limit(0).select("source", "target", "type"), new)
    assert {r.id: r.props for r in n.collect()} == {"a": {"x": "9"}, "b": {"x": "1"}, "d": {"z": "1"}}
    assert {(r.source, r.target, r.type): r.props for r in e.collect()} == {("a", "b", "t"): {"k": "2"}, ("a", "d", "u"): {}}


def test_content_id_ignores_order_but_not_copies(spark):
    one = lambda rows: V.content_id(spark.createDataFrame([(r,) for r in rows], "v string"), F.col("v")).first().content_id
    assert one(["a", "b", "c"]) == one(["c", "a", "b"]) != one(["a", "b", "c", "c"])


def test_sources(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "labels": ["X"], "props": {"k": 1}}, {"id": "b", "labels": [], "props": {}}], "edges": [{"source": "a", "target": "b", "type": "t"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = io.read_graph(spark, str(tmp_path / "g.json")).checked()
    assert g.edges.first().id == "t|a|b" and g.edges.first().kind == "t" and json.loads(g.nodes.orderBy("id").first().props) == {"k": 1}
    with pytest.raises(ValueError):
        io.Graph(g.nodes.unionAll(g.nodes), g.edges).checked()
    (tmp_path / "t.csv").write_text("M,h,name,S,old\nM,h,name,S,new\nbad,row\nM,h,other,S,x\n")
    assert [tuple(r) for r in io.read_triples(spark, str(tmp_path / "t.csv"), "M", "name", "S").collect()] == [("h", "new")]
    (tmp_path / "n.csv").write_text("id:ID,:LABEL,name\na,X;Y,first\n")
    (tmp_path / "e.csv").write_text(":START_ID,:END_ID,:TYPE\na,a,loop\n")
    c = io.read_csv_graph(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert c.nodes.first().labels == ["X", "Y"] and c.edges.first().id == "loop|a|a"
    (tmp_path / "l.jsonl").write_text('{"seq": 1}\nnot json\n')
    good, bad = io.read_lines(spark, str(tmp_path / "l.jsonl"), "seq int")
    assert (good.count(), bad.count()) == (1, 1)
    with pytest.raises(Exception, match="(?i)malformed|failfast|bad"):
        io.read_ledger(spark, str(tmp_path / "l.jsonl"), "seq int").collect()


def test_package_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("b", ["X"], None), ("a", ["Y"], "{}")], "id string, labels array<string>, props string")
    e = spark.createDataFrame([("t|a|b", "a", "b", "t", "t", None)], "id string, source string, target string, type string, kind string, props string")
    path = str(tmp_path / "package")
    io.write_package(io.Graph(n, e), path)
    assert all(r.ok for r in io.verified_package(spark, path).collect())
    io.write_lines(n.limit(1), f"{path}/nodes")
    assert {r.part: r.ok for r in io.verified_package(spark, path).collect()} == {"nodes": False, "edges": True}


def test_upsert_reports_loss(spark):
    def write(rows):
        if any(r["id"] >= 900 for r in rows):
            raise OSError("refused")

    one = io.upsert(spark.range(1000).repartition(1), write, 100, 2).groupBy().sum().first()
    assert (one[0], one[1]) == (900, 100)


def settled(q):
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "view", 60.0), (2, 1, "2024-01-01 00:10:00", "view", 60.0), (3, 1, "2024-01-01 02:00:00", "click", 30.0), (4, 2, "2024-01-03 00:00:00", "odd", 1.0)], "event_id long, user_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = flows.budget_stream(stream, 100.0).writeStream.outputMode("update").format("memory").queryName("budget").option("checkpointLocation", str(tmp_path / "c1")).start()
    settled(q)
    batch = {r.user_id: (r.accepted, r.rejected, r.spent) for r in flows.budgets(events, 100.0).collect()}
    assert {r.user_id: (r.accepted, r.rejected, r.spent) for r in spark.table("budget").collect()} == batch == {1: (2, 1, 90.0), 2: (1, 0, 1.0)}
    assert flows.sessions(events).count() == 3
    q = flows.usage(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "c2")).start()
    settled(q)
    assert {(r.event_type, r.n) for r in spark.table("usage").collect()} == {(r.event_type, r.n) for r in flows.usage(events).collect()} == {("view", 2), ("click", 1)}
    seen = {}
    q = flows.deltas(stream, lambda df, k: seen.setdefault(k, df.count()), str(tmp_path / "c3"))
    settled(q)
    assert sum(seen.values()) == 4


def test_packages_are_staged_verified_and_promoted(spark, tmp_path, monkeypatch):
    n = spark.createDataFrame([("a", ["X"], "{}"), ("b", ["Y"], "{}"), ("c", ["Y"], "{}")], "id string, labels array<string>, props string")
    e = spark.createDataFrame([("1", "a", "b", "t", "k", None), ("2", "b", "c", "t", "k", None)], "id string, source string, target string, type string, kind string, props string")
    path = str(tmp_path / "pack")
    dry = io.write_package(io.Graph(n, e), path, dry=True)
    assert {r.part: r.n for r in dry.collect()} == {"nodes": 3, "edges": 2} and not os.path.exists(path)
    io.write_package(io.Graph(n, e), path, {"README": "text"})
    io.write_package(io.Graph(n.limit(2), e.limit(1)), path)  # takes the place of the first
    assert all(r.ok for r in io.verified_package(spark, path).collect()) and sorted(os.listdir(tmp_path)) == ["pack"]
    counts = io.write_slice(io.Graph(n, e), F.array_contains("labels", "X"), str(tmp_path / "slice"), {"dim": "label", "value": "X"}).first().asDict()
    assert counts == {"matched": 1, "attached": 1, "internal": 0, "crossing": 1}
    verify = io.verified_package
    monkeypatch.setattr(io, "verified_package", lambda s, p: verify(s, p).withColumn("ok", F.lit(False)))
    with pytest.raises(ValueError):
        io.write_package(io.Graph(n, e), path)
    assert spark.read.text(f"{path}/nodes").count() == 2  # what was there stays


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"seq": 1}\n\n{"seq": 2}\n{"seq": \n{"seq": 3}\n')
    good, bad = io.read_lines(spark, str(tmp_path / "l.jsonl"), "seq int")
    assert sorted(r.seq for r in good.collect()) == [1, 2, 3] and [(r.line, r._bad) for r in bad.collect()] == [(4, '{"seq": ')]
    with pytest.raises(ValueError, match="line 4"):
        io.read_ledger(spark, str(tmp_path / "l.jsonl"), "seq int")


def test_requests_are_refused_clamped_and_truncated(spark):
    e = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "t", "k", k) for k in range(12)], "source string, target string, type string, kind string, pos int")
    for bad in (audits.Request("filter"), audits.Request("filter", kinds=(" ",)), audits.Request("path", ("n0",)), audits.Request("walk"), audits.Request()):
        assert audits.answered(e, bad).code == "BAD_REQUEST"
    far = audits.answered(e, audits.Request("ego", ("n0",), hops=9))
    assert far.status == "truncated" and far.truncated_by == "hops" and far.clamps == {"hops": (9, 5)} and far.edges.count() == 5
    few = audits.answered(e, audits.Request("filter", types=("t",), max_edges=4))
    assert few.status == "truncated" and (few.before, few.truncated_by, few.edges.count()) == (12, "max_edges", 4)
    assert audits.answered(e, audits.Request("path", ("n3", "n0"), hops=3)).before == 3
    assert audits.answered(e, audits.Request("ego", ("zz",))).status == "no_result"
    with pytest.raises(TypeError):
        audits.strict_predicate(e, "kind")


def test_a_snapshot_is_computed_once():
    import threading

    cache, made = audits.SnapshotCache(), []
    threads = [threading.Thread(target=lambda: cache.get("s", "x", lambda: made.append(1) or len(made))) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert cache.get("s", "x", lambda: 5) == 1 and cache.get("t", "x", lambda: 5) == 5 and cache.computed == 2
