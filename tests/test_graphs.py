"""Graph operators on shapes that break naive rounds, against plain Python; the adapters' graph is sparse."""

import random
from collections import defaultdict

from sparkloom.operators import diff as D
from sparkloom.operators import graph as G


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def reached(edges, back=False):
    links = defaultdict(set)
    for a, b in edges:
        links[b if back else a].add(a if back else b)
    out = {}
    for n in {x for e in edges for x in e}:
        seen, todo = {n}, [n]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[n] = seen
    return out


def components(edges):
    fore, back = reached(edges), reached(edges, True)
    return {n: min(fore[n] & back[n]) for n in fore if len(fore[n] & back[n]) > 1}


def rings_and_chains():
    """Rings alone and with chains in and out, chains between rings, a ring through a branch, two rings that share a node, loops on one node."""
    edges = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    edges += [(f"a{i}", f"a{(i + 1) % 5}") for i in range(5)] + [("a2", "c0"), ("c0", "c1"), ("c1", "c2"), ("c2", "b1")]
    edges += [(f"b{i}", f"b{(i + 1) % 4}") for i in range(4)] + [("b3", "d0"), ("d0", "d1"), ("e0", "a1"), ("e1", "e0")]
    edges += [("s", "s1"), ("s1", "s2"), ("s2", "s"), ("s", "t1"), ("t1", "s"), ("l", "l"), ("l", "s")]
    edges += [("m0", "m1"), ("m1", "m2"), ("m2", "m0"), ("m0", "n1"), ("n1", "n2"), ("n2", "m0"), ("x", "y"), ("y", "x")]
    return edges


def test_components_against_plain_python(spark):
    r = random.Random(1)
    edges = rings_and_chains()
    edges += [(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(330)]
    got = {x.node: x.component for x in G.cycles(frame(spark, edges)).collect()}
    assert got == components(edges)


def test_a_long_ring_and_many_small_ones(spark):
    edges = [(f"k{i:05}", f"k{(i + 1) % 5000:05}") for i in range(5000)] + [(f"p{i}.{j}", f"p{i}.{(j + 1) % (2 + i % 4)}") for i in range(400) for j in range(2 + i % 4)]
    got = G.cycles(frame(spark, edges)).collect()
    assert {x.component for x in got if x.node[0] == "k"} == {"k00000"} and len(got) == len(edges)
    assert len({x.component for x in got}) == 401


def test_layers_and_impact_against_plain_python(spark):
    r = random.Random(5)
    edges = rings_and_chains() + [(f"v{a}", f"v{b}") for a, b in ((r.randrange(150), r.randrange(150)) for _ in range(260)) if a > b]
    loops, back = components(edges), reached(edges, True)
    layer = defaultdict(int)
    for _ in range(200):
        for a, b in edges:
            if a != b and loops.get(a, a) != loops.get(b, b):
                layer[b] = max(layer[b], layer[a] + 1)
    df = frame(spark, edges + edges[:20])
    assert {x.node: x.layer for x in G.layers(df).collect()} == {n: layer[n] for n in back}
    assert {x.node: x.impact for x in G.impact_sizes(df).collect()} == {n: len(s) - 1 for n, s in back.items()}
    about = {x.node: x.impact for x in G.impact_sizes(df, exact=False).collect()}
    assert all(abs(about[n] - len(s) + 1) <= 2 + len(s) // 20 for n, s in back.items())
    seeds = [(k, f"v{r.randrange(150)}") for k in range(20) for _ in range(3)] + [(99, "no edge has it"), (99, "v1")]
    got = {x.k: x.impacted for x in G.impact_counts(df, spark.createDataFrame(seeds, "k int, node string"), "k").collect()}
    assert got == {k: len(set().union(*[back.get(n, {n}) for j, n in seeds if j == k])) for k, _ in seeds}


def test_impact_changes_of_two_snapshots(spark):
    a, b = [("x", "y"), ("y", "z"), ("u", "z")], [("x", "y"), ("u", "z"), ("u", "y"), ("w", "u")]
    nodes = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    got = D.impact_changes((frame(spark, a), nodes("xyzuq")), (frame(spark, b), nodes("xyzuqw"))).collect()
    assert sorted(map(tuple, got)) == [("u", 0, 1, 1), ("y", 1, 3, 2), ("z", 3, 2, -1)]


def test_shortest_paths_are_read_by_leaps(spark):
    r = random.Random(3)
    edges = [(f"p{i:03}", f"p{i + 1:03}", i % 2 == 0, i) for i in range(35)] + [(f"p{a:03}", f"p{b:03}", False, 9) for a, b in ((r.randrange(35), r.randrange(35)) for _ in range(30)) if a > b]
    df = spark.createDataFrame(edges + [("q", "p000", True, 1), ("p034", "z", True, 2)], "src string, dst string, deferred boolean, line int")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    path = sorted(map(tuple, G.shortest_path(df, one("q"), one("p035")).collect()))
    assert [x[:3] for x in path] == [(1, "q", "p000")] + [(k + 2, f"p{k:03}", f"p{k + 1:03}") for k in range(35)] and path[3][3:] == (True, 2)
    assert G.shortest_path(df, one("p035"), one("q")).collect() == [] == G.shortest_path(df, one("q"), one("q")).collect()
    ties = frame(spark, [("s", "b"), ("s", "a"), ("a", "t"), ("b", "t")])
    assert [tuple(x) for x in G.shortest_path(ties, one("s"), one("t")).orderBy("step").collect()] == [(1, "s", "a"), (2, "a", "t")]


def test_the_adapters_graph_is_sparse_and_has_shapes():
    import duckdb

    from sparkloom.sources.adapters import with_clause

    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    edges = c.sql(with_clause() + " SELECT src, dst FROM edges").fetchall()
    back, groups = reached(edges, True), defaultdict(int)
    for g in components(edges).values():
        groups[g] += 1
    both = reached(edges + [(b, a) for a, b in edges])
    assert len(edges) < 2.5 * len(back) and len(groups) >= 10 and set(groups.values()) == {2, 3, 4, 5, 6}
    assert len({frozenset(x) for x in both.values()}) >= 3 and len({len(x) for x in back.values()}) >= 20
