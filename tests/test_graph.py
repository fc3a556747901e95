from __future__ import annotations

import random

from pyspark.sql import functions as F

from sitemill.operators import graph as G


def follow(hops, start, live=(), limit=20):
    path, current = [start], start
    while current in hops and current not in live:
        current = hops[current]
        if current in path or len(path) > limit:
            return None
        path.append(current)
    return current, len(path) - 1


def test_closure_matches_brute_force(spark):
    rng = random.Random(7)
    hops = {f"n{i}": f"n{i + 1}" for i in range(45)}
    hops |= {f"r{i}": f"r{rng.randrange(60)}" for i in range(50)} | {"s": "s", "a": "b", "b": "a", "c": "a"}
    live = {"n44", "r3"}
    edges = spark.createDataFrame(list(hops.items()), "src string, dst string")
    got = {r.src: r for r in G.redirect_closure(edges, spark.createDataFrame([(x,) for x in live], "route string")).collect()}
    assert set(got) == set(hops) - live
    for src, row in got.items():
        expected = follow(hops, src, live)
        end = follow(hops, src, live, limit=10**6)
        assert (row.final, row.hops) == end if end else row.cycle, src
        assert row.too_long == bool(end and not expected), src


def test_chain_limits(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60)] + [(f"c{i}", f"c{(i + 1) % 60}") for i in range(60)], "src string, dst string")
    got = {r.src: r for r in G.redirect_closure(edges).collect()}
    assert got["n0"].final == "n60" and got["n0"].hops == 60 and got["n0"].too_long and not got["n0"].cycle
    assert not got["n40"].too_long and got["n39"].too_long
    assert all(got[f"c{i}"].cycle and got[f"c{i}"].final is None for i in range(60))


def test_cycle_members(spark):
    rng = random.Random(3)
    hops = {i: rng.randrange(120) for i in range(100)}
    expected = set()
    for start in hops:
        seen, node = [], start
        while node in hops and node not in seen:
            seen.append(node)
            node = hops[node]
        if node in seen:
            expected |= set(seen[seen.index(node):])
    edges = spark.createDataFrame(list(hops.items()), "src int, dst int")
    assert {r.node for r in G.cycle_members(edges).collect()} == expected


def test_tree(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5), (7, 5), (8, 8)], "id int, parent_id int")
    assert {tuple(r) for r in G.tree_ancestors(nodes).collect()} == {(2, 1, 1), (3, 2, 1), (3, 1, 2), (5, 6, 1), (6, 5, 1), (7, 5, 1), (7, 6, 2)}
    assert {tuple(r) for r in G.tree_subtree(nodes).where("id = 1").collect()} == {(1, 1), (1, 2), (1, 3)}
    assert {r.id for r in G.tree_roots(nodes).collect()} == {1, 4}
    assert {(r.id, r.parent_id) for r in G.repair_parent_cycles(nodes).where("was_cyclic").collect()} == {(5, None), (6, None), (8, None)}


def test_dependency_levels_and_reachability(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id int")
    edges = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 2), (4, 5), (5, 4), (6, 5)], "id int, needs int")
    assert {r.id: r.level for r in G.dependency_levels(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: None, 5: None, 6: None, 7: 0}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in G.reachable(links, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    chain = spark.createDataFrame([(i, i + 2) for i in range(30)], "node int, next int")
    assert {r.node for r in G.chain_members(chain, spark.createDataFrame([(1,)], "node int")).collect()} == set(range(1, 33, 2))


def test_cascade(spark):
    needs = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "id int, needs_id int")
    got = G.cascade_drop(spark.createDataFrame([(1,)], "id int"), needs).collect()
    assert {(r.id, r.round) for r in got} == {(1, 0), (2, 1), (3, 2)}


def walk(nodes, order):
    """Places of a depth-first walk, depths, and positions within the root's tree."""
    kids, known = {}, {n for n, _ in nodes}
    for n, up in nodes:
        kids.setdefault(up if up in known and up != n else None, []).append(n)
    out, clock = {}, 0

    def visit(n, depth, root, place):
        nonlocal clock
        enter, clock = clock, clock + 1
        count = place[0] = place[0] + 1
        for kid in sorted(kids.get(n, []), key=lambda k: (order[k], k)):
            if kid != n:
                visit(kid, depth + 1, root, place)
        out[n] = (root, depth, enter, clock, count)
        clock += 1

    for root in kids.get(None, []):
        clock = 0
        visit(root, 0, root, [0])
    return out


def test_tree_labels(spark):
    rng = random.Random(11)
    nodes = [(k, rng.choice([None, k, 10**6, *range(k)]) if k % 9 == 0 else rng.randrange(k)) for k in range(1, 300)] + [(0, None)] + [(500, 501), (501, 502), (502, 500), (503, 501)]
    order = {n: rng.randrange(4) for n, _ in nodes}
    df = spark.createDataFrame([(n, up, order[n]) for n, up in nodes], "id long, parent_id long, o int")
    want = walk([x for x in nodes if x[0] < 500], order)
    labels = G.tree_labels(df, F.col("o"))
    got = {r.id: r for r in labels.collect()}
    assert set(got) == {n for n, _ in nodes} and all(got[n].enter is None for n in (500, 501, 502, 503))
    for n, (root, depth, enter, leave, _) in want.items():
        assert (got[n].root, got[n].depth, got[n].enter, got[n].leave) == (root, depth, enter, leave), n
    assert {r.id: r.position for r in G.tree_order(df, F.col("o")).where("position is not null").collect()} == {n: w[4] for n, w in want.items()}
    below = {(a, b) for a, wa in want.items() for b, wb in want.items() if wa[0] == wb[0] and wa[2] <= wb[2] <= wa[3]}
    asked = spark.createDataFrame([(n,) for n in range(0, 60)], "id long")
    assert {tuple(r) for r in G.members_of(labels, asked).collect()} == {(a, b) for a, b in below if a < 60}
    assert {tuple(r) for r in G.ancestors_of(labels, asked).collect()} == {(b, a, want[b][1] - want[a][1]) for a, b in below if b < 60 and a != b}
    sums = {r.id: r.total for r in G.subtree_totals(labels, spark.createDataFrame([(b, b) for b in want] + [(7, 5)], "id long, value long")).collect()}
    assert sums == {a: sum(b + (5 if b == 7 else 0) for x, b in below if x == a) for a in want}
    assert G.tree_labels(df.limit(0)).count() == 0


def test_ranges_meet_their_points_once(spark):
    rng = random.Random(2)
    points = [(rng.randrange(2), rng.randrange(300_000), k) for k in range(300)]
    spans = [(rng.randrange(2), *sorted((rng.randrange(300_000), rng.randrange(300_000)))) for _ in range(40)] + [(0, 0, 299_999), (1, 5, 5), (1, 16, 31), (0, 65_536, 131_071)]
    got = G.within_ranges(spark.createDataFrame(points, "root int, at long, p int"), spark.createDataFrame([(*s, k) for k, s in enumerate(spans)], "root int, low long, high long, r int"))
    assert sorted((r.p, r.r) for r in got.collect()) == sorted((p, k) for root, at, p in points for k, (other, low, high) in enumerate(spans) if root == other and low <= at <= high)


def test_dependency_levels_of_any_graph(spark):
    rng = random.Random(4)
    edges = {(n, rng.randrange(n)) for n in range(1, 150) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))} | {(150, 151), (151, 152), (152, 150), (153, 152), (153, 3), (154, 999), (155, 154), (155, 20), (20, 20)}
    needs = {}
    for a, b in edges:
        needs.setdefault(a, set()).add(b)
    level = {}
    for _ in range(200):
        for n in range(156):
            if n not in level and all(b in level for b in needs.get(n, ())):
                level[n] = max((level[b] + 1 for b in needs.get(n, ())), default=0)
    got = G.dependency_levels(spark.range(156), spark.createDataFrame(sorted(edges), "id long, needs long"))
    assert {r.id: r.level for r in got.collect()} == {n: level.get(n) for n in range(156)}


def test_long_chains(spark):
    """Chains as deep as they have nodes; rounds grow with the logarithm of their length."""
    size = 4_000
    chain = spark.range(size).selectExpr("id", "nullif(id, 0) - 1 AS parent_id").cache()
    last = G.dependency_levels(chain.select("id"), chain.where("id > 0").select("id", F.col("parent_id").alias("needs")))
    assert last.where("level <> id OR level IS NULL").count() == 0
    labels = G.tree_labels(chain)
    assert labels.where(f"enter <> id OR depth <> id OR leave <> {2 * size - 1} - id").count() == 0
    asked = spark.createDataFrame([(size - 1,), (7,)], "id long")
    assert G.ancestors_of(labels, asked).groupBy("id").count().orderBy("id").collect() == [(7, 7), (size - 1, size - 1)]
    assert G.members_of(labels, asked).groupBy("id").count().orderBy("id").collect() == [(7, size - 7), (size - 1, 1)]


def test_reachable_reads_blocks(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(260)] + [(None, 3), (3, None)] + [(1000 + k, 1001 + k) for k in range(30)]
    seeds = [3, 9, 1000, None, 5000]
    steps, frontier = {s: 0 for s in seeds if s is not None}, {s for s in seeds if s is not None}
    while frontier:
        frontier = {b for a, b in links if a in frontier and b is not None} - set(steps)
        steps |= {n: max(steps.values()) + 1 for n in frontier}
    for size in (10, 10**6):
        got = G.reachable(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "node long"), size)
        assert {r.node: r.steps for r in got.collect()} == steps


def test_cut_rows_have_their_own_size(spark):
    from sitemill.session import cut_lineage

    step = cut_lineage(spark.range(100).selectExpr("id", "(id + 1) % 100 AS at"))
    for _ in range(4):
        ahead = step.selectExpr("id AS at", "at AS next")
        step = cut_lineage(step.join(ahead, "at").selectExpr("id", "next AS at"))
    assert step.where("at <> (id + 16) % 100").isEmpty() and step.count() == 100
    # the estimate of a join is the product of its sides: carried along it would be squared each round
    assert int(str(step._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000
