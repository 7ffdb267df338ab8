"""What decides how a query fares on large tables: which rows are broadcast or sent, and results on keys beyond those of the small ones."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators import views as V
from sparkloom.operators.intervals import meeting
from sparkloom.plans import catalog, views  # noqa: F401
from sparkloom.sources.adapters import BASE, Tables, with_clause

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def oracle(folder, text):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(text).fetchall()


def changed(tmp_path, **selects):
    """A copy of the small tables, some of them read through a SELECT."""
    for t in BASE:
        text = selects.get(t, "SELECT * FROM {0}").format(f"'{SMALL}/{t}.parquet'")
        duckdb.connect().execute(f"COPY ({text}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_parts_are_not_broadcast(spark):
    plan = str(catalog.FOUND["dead_locals"](spark, SMALL)._jdf.queryExecution().sparkPlan())
    joins = [x for x in plan.split("\n") if "BroadcastHashJoin" in x]
    assert not [x for x in joins if "[mk#" in x or ", text#" in x]
    # calls are made distinct as pairs of keys, not as six names
    assert not [x for x in plan.split("\n") if "HashAggregate(keys=[" in x and "from_key" in x and "to_key" in x]


def test_calls_are_those_of_their_sql(spark, tmp_path):
    folder = changed(tmp_path, part="SELECT * FROM {0} UNION ALL SELECT * FROM {0} WHERE p_partkey < 40", lineitem="SELECT * FROM {0} UNION ALL SELECT * FROM {0} WHERE l_orderkey % 3 = 0")
    want = oracle(folder, with_clause() + " SELECT * FROM calls")
    assert Counter(want) == Counter(map(tuple, Tables(spark, folder).calls.collect())) and len(want) > 1000


def test_spans_meet_as_all_pairs_do(spark):
    rng = random.Random(5)
    spans = lambda n: [(rng.choice("xy"), f := rng.choice([rng.randint(0, 3000), rng.randint(0, 60)]), f + rng.choice([0, 3, 40, 900, 20000]), i) for i in range(n)]
    a, b = spans(150) + [("x", 50, 40, 900)], spans(120)
    got = meeting(spark.createDataFrame(a, "n string, a_first long, a_last long, i int"), spark.createDataFrame(b, "n string, b_first long, b_last long, j int"), ["n"])
    want = [(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]]
    assert rows(got.select("i", "j")) == sorted(want, key=str)


def test_history_sends_no_row_for_a_commit_and_caller(spark):
    hit = [(s, f) for s in range(30) for f in range(10) if (s * 7 + f) % 4 == 0] + [(1, 3), (1, 3)]
    calls = [(a, b) for a in range(14) for b in range(10) if a != b and (a * 5 + b) % 3 == 0]
    want = []
    for s in range(32):
        met = {f for x, f in hit if x == s}
        want.append((s, 2 if s % 2 else 1, len(met), len({a for a, b in calls if b in met} - met)))
    hunks = [(s, p) for s in range(32) for p in ("p", "q", "p")[: 3 if s % 2 else 1]]
    for kind in ("long", "string"):
        frames = [spark.createDataFrame(hit, "sha long, fn_key int"), spark.createDataFrame(hunks, "sha long, path string")]
        frames = [x.withColumn("sha", F.col("sha").cast(kind)) for x in frames]
        got = V.history_rollup(*frames, spark.createDataFrame(calls, "from_key int, to_key int"), each=20)
        assert rows(got.select(F.col("sha").cast("long"), "files", "touched", "callers")) == sorted(want, key=str)
        sent = [x for x in str(got._jdf.queryExecution().executedPlan()).split("\n") if "Exchange" in x]
        assert not [x for x in sent if "from_key" in x and "sha" in x]


def test_hottest_function_with_keys_beyond_a_million(spark, tmp_path):
    folder = changed(tmp_path, part="SELECT * REPLACE (p_partkey + p_size * 1000000 AS p_partkey) FROM {0}")
    want = oracle(folder, catalog.SQL["churn_hotspots"])
    assert rows(catalog.FOUND["churn_hotspots"](spark, folder)) == sorted(want, key=str)


def test_nothing_is_searched_for_cycles_in_a_tree(spark, monkeypatch):
    seen, search = [], G._by_pivots
    monkeypatch.setattr(G, "_by_pivots", lambda edges: (seen.append(edges.count()), search(edges))[1])
    tree = spark.createDataFrame([(f"n{k}", f"n{k // 5 * 2}") for k in range(1000) if k % 5 > 1], "src string, dst string")
    assert G.cycles(tree).isEmpty() and seen == [0]
