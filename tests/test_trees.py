"""Trees by interval labels against plain Python."""

import random
from collections import defaultdict

import pytest

from sparkloom.operators import aggregate as A
from sparkloom.operators import trees as T

SHAPE = "node_id string, parent_id string, ord long, depth int, language string"


def plain(rows):
    kids, by = defaultdict(list), {x[0]: x for x in rows}
    for n, p, o, *_ in rows:
        kids[p if p in by else None].append((o, n))
    order, out, todo = [], {}, [(n, True) for _, n in sorted(kids[None], reverse=True)]
    while todo:
        n, enter = todo.pop()
        order.append((n, enter))
        if enter:
            todo.append((n, False))
            todo += [(x, True) for _, x in sorted(kids[n], reverse=True)]
    for n, enter in reversed(order):
        if not enter:
            out[n] = {n}
    for n, enter in order:
        if not enter:
            for _, x in kids[n]:
                out[n] |= out[x]
    return order, out


def forest():
    r = random.Random(6)
    rows = [("r", None, 0, 0, None), ("q", "gone", 1, 0, "c")]
    for k in range(300):
        up = r.choice(rows)
        rows.append((f"n{k}", up[0], r.randrange(5), up[3] + 1, r.choice(("lua", "py", None))))
    return rows


def test_labels_sums_facets_and_ancestors(spark):
    rows = forest()
    order, below = plain(rows)
    nodes = spark.createDataFrame(rows, SHAPE)
    got = sorted((x.place, x.node_id, x.enter) for x in T.labels(nodes).collect())
    assert [x[0] for x in got] == list(range(len(order))) and [x[1:] for x in got] == order
    stats = {n: k for k, (n, *_) in enumerate(rows) if k % 3}
    sums = {x.node_id: (x.a, x.b) for x in T.subtree_sums(nodes, spark.createDataFrame([(n, v, -v) for n, v in stats.items()], "node_id string, a long, b long"), ["a", "b"]).collect()}
    assert sums == {n: (sum(stats.get(x, 0) for x in s), -sum(stats.get(x, 0) for x in s)) for n, s in below.items()}
    of = {x[0]: x for x in rows}
    assert {x.node_id: x.languages for x in A.facets(nodes).collect()} == {n: t for n, s in below.items() if (t := ",".join(sorted({of[x][4] for x in s} - {None})))}
    tops = {x.node_id: x.group_id for x in T.ancestor_at(nodes, 2).collect()}
    assert tops == {n: n if of[n][3] < 2 else next(m for m, s in below.items() if of[m][3] == 2 and n in s) for n in of}


def test_a_tree_of_ten_thousand_levels(spark):
    nodes = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else None, 0, k, None) for k in range(10_000)], SHAPE)
    got = {x.node_id: x.one for x in T.subtree_sums(nodes, nodes.selectExpr("node_id", "1L AS one"), ["one"]).collect()}
    assert got == {f"n{k}": 10_000 - k for k in range(10_000)}


def test_a_parent_below_itself_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(T, "DOUBLINGS", 8)
    with pytest.raises(ValueError):
        T.labels(spark.createDataFrame([("a", "b", 0), ("b", "a", 0)], "node_id string, parent_id string, ord long"))
