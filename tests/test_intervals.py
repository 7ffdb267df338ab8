"""Interval joins, route tries and trees by interval labels against plain Python."""

import random
import re
from math import log2

from sparkloom.operators import intervals as I
from sparkloom.operators import resolve as R


def test_covers_are_exact_and_short(spark):
    r = random.Random(1)
    spans = [(a, a + r.choice((0, 1, 5, 63, 64, 1000, r.randrange(100_000)))) for a in (r.randrange(0, 50_000) for _ in range(200))] + [(5, 4), (0, 0), (1, 1_000_000)]
    got = spark.createDataFrame(spans, "f long, l long").select("f", "l", I.cover("f", "l").alias("c")).collect()
    for f, last, cells in got:
        parts = sorted((c.cell << c.level, (c.cell + 1 << c.level) - 1) for c in cells)
        assert sum(b - a + 1 for a, b in parts) == max(0, last - f + 1) and len(parts) <= 2 * log2(max(2, last - f + 2))
        assert all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:], strict=False)) and (not parts or (parts[0][0], parts[-1][1]) == (f, last))


def test_overlaps_against_all_pairs(spark):
    """Short spans, points, empty ones, and one as long as the file."""
    r = random.Random(2)
    make = lambda n, long: [(k, "ab"[k % 2], f, f + r.choice((-1, 0, 3, 40, long))) for k, f in enumerate(r.randrange(1, 900) for _ in range(n))]
    a, b = make(120, 1_000_000) + [(120, "a", 1, 10**9)], make(150, 500)
    one = spark.createDataFrame(a, "i long, key string, a_first long, a_last long")
    two = spark.createDataFrame(b, "j long, key string, b_first long, b_last long")
    got = sorted(map(tuple, I.overlapping(one, two, ["key"]).select("i", "j").collect()))
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and max(x[2], y[2]) <= min(x[3], y[3]))
    plan = I.overlapping(one, two, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_routes_walk_a_trie(spark):
    """10,000 routes; parameters, parts of segments, last slashes, methods; no nested loop."""
    routes = [("/", "get"), ("/en/:id", "get"), ("/en/new", "all"), ("/en/{id}/x", "post"), ("/f/:name.json", "get"), ("/f/:name.json", "put"), ("/:a/:b", "all"), ("/en/new/", "get"), ("/a.b/*", "get")]
    routes += [(f"/r{k}/:id/s{k % 7}", "get") for k in range(10_000)]
    urls = ["http://h", "http://h/", "http://h/en/5?x#y", "http://h/en/new", "http://h/en/new/", "{{base}}/en/5/x", "/f/a.json", "/f/axjson", "/r5/9/s5", "/r6/9/s5/", "/r12//s5", "/a.b/*", "/axb/*", "en/5", "/=en/~", "/q/w/e/r/t"]
    requests = [(m, u) for m in ("GET", "post", "Put") for u in urls] * 2
    found = R.route_coverage(spark.createDataFrame(routes, "route string, method string"), spark.createDataFrame(requests, "method string, url string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(x.route, x.method): x.hits for x in found.collect()}

    def fits(route, url):
        path = re.sub(r"[?#].*", "", re.sub(r"^[a-z]+://[^/?#]*", "", url.replace("{{base}}", ""))) or "/"
        parts = [re.escape(x) for x in re.split(R.PARAMETER, route.rstrip("/"))]
        return re.fullmatch("".join(p if i % 2 == 0 else "[^/]+" for i, p in enumerate(parts)) + "/?", path) is not None

    few = [x for x in routes if not x[0].startswith("/r") or x[0].startswith(("/r5/", "/r6/", "/r12/"))]
    assert len(got) == len(routes) and sum(got.values()) > 0
    for route, method in few:
        assert got[route, method] == sum(fits(route, u) and method in ("all", m.lower()) for m, u in requests), (route, method)
    assert all(n == 0 for (route, _), n in got.items() if route not in {x[0] for x in few})


def test_deferred_requires_lie_inside_functions(spark):
    from sparkloom.operators.extract import deferred

    lines = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "node_id string, line int")
    spans = spark.createDataFrame([("a", 4, 8), ("a", 5, 10_000_000), ("c", 1, 9), ("b", 6, None)], "node_id string, first int, last int")
    assert sorted(map(tuple, deferred(lines, spans).select("node_id", "line", "deferred").collect())) == [("a", 1, False), ("a", 5, True), ("a", 9, True), ("b", 5, False)]
