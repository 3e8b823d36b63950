import random

import pytest
from pyspark.sql import functions as F

from partloom.operators import graph
from partloom.operators.hierarchy import Hierarchy, above, below, contained, links
from partloom.operators.stars import weak_groups

from .conftest import rows

OWN = [("top1", "a"), ("top1", "b"), ("top2", "b"), ("top2", "c"), ("a", "d"), ("b", "d"), ("b", "e"), ("d", "e"), ("e", "f"), ("c", "f"), ("c", "g")]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "parent string, child string")


def brute(pairs):
    """(levels below each root, parts on cycles with the smallest key of their group) by plain search."""
    out = {}
    for p, c in pairs:
        out.setdefault(p, set()).add(c)
    nodes = {x for e in pairs for x in e}

    def reach(a):
        seen, front, level = {}, {a}, 0
        while front:
            level += 1
            front = {c for x in front for c in out.get(x, ()) if c not in seen}
            seen |= dict.fromkeys(front, level)
        return seen

    all_ = {n: reach(n) for n in nodes}
    roots = {p for p, c in pairs if p != c} - {c for p, c in pairs if p != c}
    levels = {(r, x): n for r in roots for x, n in all_[r].items() if x != r}
    cyc = {(min([m for m in all_[n] if n in all_[m]]), n) for n in nodes if n in all_[n]}
    return levels, cyc


def test_levels_paths_and_ranges(spark):
    h = Hierarchy(edges(spark, OWN))
    p = h.places(with_paths=True).cache()
    assert {(r[0], r[1]): r[2] for r in rows(p, "root", "part", "level") if r[2]} == brute(OWN)[0]
    assert rows(p.where("root = 'top2' and part = 'f'"), "path") == [(["top2", "c", "f"],)]
    assert rows(p.where("root = 'top1' and part = 'd'"), "path") == [(["top1", "a", "d"],)]
    # in the forest b hangs below top1, d below a, e below b; f is a place of its own below c and below e
    assert rows(below(h, "b")) == [("e", 1), ("f", 2)]
    assert rows(below(h, "top1")) == [("a", 1), ("b", 1), ("d", 2), ("e", 2), ("f", 3)]
    assert rows(above(h, "f")) == [("b", 2), ("c", 1), ("e", 1), ("top1", 3), ("top2", 2)]
    assert not h.has_cycle and h.cycles().count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_search(spark, seed):
    rnd = random.Random(seed)
    n = 30
    pairs = sorted({(f"P{rnd.randrange(n):02d}", f"P{rnd.randrange(n):02d}") for _ in range(45)} | {(f"R{i}", f"P{rnd.randrange(n):02d}") for i in range(4)} | {(f"R{seed}", f"R{seed}")})
    levels, cyc = brute(pairs)
    h = Hierarchy(edges(spark, pairs))
    assert {(r[0], r[1]): r[2] for r in rows(h.places(), "root", "part", "level") if r[2]} == levels
    assert set(rows(h.cycles())) == cyc and h.has_cycle
    paths = h.places(with_paths=True).where("level > 0").collect()
    assert {(r["root"], r["part"]): r["level"] for r in paths} == levels
    known = set(pairs)
    for r in paths:
        way = r["path"]
        assert way[0] == r["root"] and way[-1] == r["part"] and len(way) == r["level"] + 1 and all(x in known for x in zip(way, way[1:]))


def smallest_paths(pairs, root):
    """The smallest of the shortest paths from the root to each part."""
    best, front = {root: [root]}, {root: [root]}
    while front:
        nxt = {}
        for a, way in front.items():
            for p, c in pairs:
                if p == a and c not in best and (c not in nxt or way + [c] < nxt[c]):
                    nxt[c] = way + [c]
        best |= nxt
        front = nxt
    return best


def test_smallest_shortest_paths_and_closure(spark):
    rnd = random.Random(100)
    pairs = sorted({(f"P{rnd.randrange(14):02d}", f"P{rnd.randrange(14):02d}") for _ in range(26)})
    h = Hierarchy(edges(spark, pairs))
    seeds = sorted({x for e in pairs for x in e})
    got = {(r["root"], r["part"]): r["path"] for r in h.places(True, spark.createDataFrame([(x,) for x in seeds], "part string")).collect()}
    assert got == {(s, p): way for s in seeds for p, way in smallest_paths(pairs, s).items()}


def test_self_linked_top_is_a_root(spark):
    pairs = [("T", "T"), ("T", "A"), ("A", "B"), ("S", "S")]
    h = Hierarchy(edges(spark, pairs))
    assert rows(h.roots()) == [("T",)]
    assert rows(h.places().where("level > 0"), "root", "part", "level") == [("T", "A", 1), ("T", "B", 2)]
    assert rows(h.cycles()) == [("S", "S"), ("T", "T")]


def test_long_chain_ring_and_two_rings(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    ring = [(f"r{i:03d}", f"r{(i + 1) % 70:03d}") for i in range(70)]
    pairs = chain + ring + [("c150", "r005"), ("r060", "x1"), ("c010", "r007"), ("u1", "u2"), ("u2", "u1"), ("u2", "r001")]
    levels, cyc = brute(pairs)
    h = Hierarchy(edges(spark, pairs))
    assert {(r[0], r[1]): r[2] for r in rows(h.places(), "root", "part", "level") if r[2]} == levels
    assert set(rows(h.cycles())) == cyc
    deep, endless = h.longest()
    assert endless.count() == 151 + 70 + 2 and deep.count() == 0


def test_longest_chains_of_shared_parts(spark):
    rnd = random.Random(7)
    pairs = sorted({(f"P{a:02d}", f"P{b:02d}") for a, b in ((rnd.randrange(25), rnd.randrange(25)) for _ in range(60)) if a < b})
    out = {}
    for p, c in pairs:
        out.setdefault(p, []).append(c)

    def deep(x):
        return max((1 + deep(c) for c in out.get(x, ())), default=0)

    got, endless = Hierarchy(edges(spark, pairs)).longest()
    assert rows(got) == sorted((p, deep(p)) for p in out) and endless.count() == 0


def test_points_in_ranges(spark):
    rnd = random.Random(3)
    rs = [(i % 3, a, min(a + rnd.randrange(40), 99), i) for i, a in enumerate(rnd.randrange(1, 100) for _ in range(60))]
    ps = [(i % 3, rnd.randrange(1, 100), 100, i) for i in range(60)]
    got = contained(spark.createDataFrame(rs, "k int, lo long, hi long, r int"), spark.createDataFrame(ps, "k int, pos long, span long, p int"), "k", 7)
    assert rows(got, "r", "p") == sorted(((r, p) for k, lo, hi, r in rs for q, at, _, p in ps if k == q and lo <= at <= hi), key=repr)


def test_hot_keys_of_every_step(spark, monkeypatch):
    """A shared part with parts below it, a part with very many parts below, and a giant group, with every key of ten rows counted as hot."""
    from partloom.operators import hierarchy, skew

    pairs = [(f"A{i}", "HOT") for i in range(300)] + [("HOT", f"D{i:03d}") for i in range(200)] + [(f"D{i:03d}", f"E{i:03d}") for i in range(200)] + [("E007", "HOT2"), ("E008", "HOT2"), ("HOT2", "HOT"), ("HOT2", "z")]
    levels, cyc = brute(pairs)
    wide = lambda left, right, on, how="left", **kw: skew.join_unique(left, right, on, how, least=10)
    monkeypatch.setattr(hierarchy, "join_unique", wide)
    monkeypatch.setattr(hierarchy, "ROWS_PER_SALT", 20)
    monkeypatch.setattr(hierarchy, "STRETCH", 8)
    h = Hierarchy(edges(spark, pairs))
    assert {(r[0], r[1]): r[2] for r in rows(h.places(), "root", "part", "level") if r[2]} == levels
    assert set(rows(h.cycles())) == cyc


def test_cleaning_and_empty(spark):
    raw = spark.createDataFrame([(" a ", "B", 1), ("A", "b\t", 2), (None, "B", 3), ("A", " ", 4)], "p string, c string, parent int")
    assert rows(links(raw, "p", "c")) == [("A", "B")]
    h = Hierarchy(edges(spark, []))
    assert h.places().count() == 0 and h.cycles().count() == 0 and h.roots().count() == 0


def test_one_child_under_many_parents(spark):
    pairs = [(f"A{i}", "HOT") for i in range(3000)] + [("HOT", "X"), ("X", "X")]
    h = Hierarchy(edges(spark, pairs))
    assert h.places().where("level > 0").count() == 6000
    assert rows(h.cycles()) == [("X", "X")]


def test_graph_measures(spark):
    e = edges(spark, OWN + [("x", "y")]).withColumn("quantity_per", F.lit(1))
    h = Hierarchy(e.select("parent", "child"))
    r = graph.reach(h).cache()
    assert rows(graph.roots(e)) == [("top1",), ("top2",), ("x",)]
    assert rows(graph.leaves(e)) == [("f",), ("g",), ("y",)]
    depth = dict((a, b) for a, b, _ in rows(graph.depths(h, r)))
    assert depth == {"top1": 4, "a": 3, "b": 3, "top2": 4, "c": 1, "d": 2, "e": 1, "f": 0, "g": 0, "x": 1, "y": 0}
    assert rows(graph.max_depth(h, r)) == [(4,)]
    assert rows(r.where("below = 'd'"), "part") == [("a",), ("b",), ("top1",), ("top2",)]
    assert rows(graph.expansion(h, e, "d"), "parent", "child", "level", "quantity_per") == [("d", "e", 1, 1), ("e", "f", 2, 1)]
    demand = spark.createDataFrame([("top1", 100.0), ("top2", 50.0)], "part_key string, demand_qty double")
    assert rows(graph.criticality(r, e, demand).where("part = 'd'"), "affected_assemblies", "criticality_score") == [(4, 6.5)]
    sup = spark.createDataFrame([("e", "S1"), ("f", "S1"), ("f", "S2")], "part_id string, supplier_id string")
    assert rows(graph.concentration(r, e, sup).where("part = 'd'"), "single_source_components", "single_source_ratio") == [(1, 0.5)]
    assert weak_groups(e).select("group_key").distinct().count() == 2
    assert rows(graph.simple_paths(e, "top1", "e"), "path") == [(["top1", "a", "d", "e"],), (["top1", "b", "d", "e"],), (["top1", "b", "e"],)]


def test_cycles(spark):
    e = edges(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("B", "A"), ("X", "X")])
    found = graph.simple_cycles(Hierarchy(e))
    assert rows(found) == sorted([(["A", "B"], 2), (["A", "B", "C"], 3)], key=repr)
    h = Hierarchy(edges(spark, [("A", "B"), ("B", "C"), ("C", "B")]))
    assert dict((a, b) for a, b, _ in rows(graph.depths(h, graph.reach(h))))["A"] == 2


def test_long_cycles(spark):
    ring = [(f"p{i:02d}", f"p{(i + 1) % 15:02d}") for i in range(15)]
    found = graph.simple_cycles(Hierarchy(spark.createDataFrame([*ring, ("p03", "p00")], "parent string, child string")))
    assert sorted((r["n_links"], r["cycle"]) for r in found.collect()) == [(4, [f"p{i:02d}" for i in range(4)]), (15, [f"p{i:02d}" for i in range(15)])]
