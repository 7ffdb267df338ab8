"""Operators that read text, resolve or serve: against rows written out."""

import json

import pytest

from sparkloom.functions import scalar as S
from sparkloom.operators import aggregate as A
from sparkloom.operators import checks as C
from sparkloom.operators import extract as X
from sparkloom.operators import graph as G
from sparkloom.operators import resolve as R
from sparkloom.operators import sinks as K
from sparkloom.plans import registry
from sparkloom.sources import files as S_FILES


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_code_spans(spark):
    text = "a `x` ``b `c` d`` e\n````\n`no`\n```\n````\n~~~ lua\n```\n`no`\n~~~\n` y ` `` ` ``\n```\n`never`"
    assert rows(X.code_spans(spark.createDataFrame([("f", text), ("e", ""), ("n", None)], "node_id string, content string"))) == [("f", 1, "b `c` d"), ("f", 1, "x"), ("f", 10, "`"), ("f", 10, "y")]


def test_ladder_rungs(spark):
    fns = spark.createDataFrame([("a", "M.go", "a#go", 1), ("a", "near", "a#near", 2), ("b", "run", "b#run", 3), ("c", "X.only", "c#only", 4), ("d", "twin", "d#twin", 5), ("e", "twin", "e#twin", 6)], "node_id string, fn_name string, fn_key string, k int")
    nodes = spark.createDataFrame([("a", "p", "go"), ("b", "p", "go"), ("c", "q", "go"), ("d", "p", "go"), ("e", "p", "go")], "node_id string, parent_id string, language string")
    near = R.package_siblings(fns, nodes)
    assert rows(near.select("parent_id", "name")) == [("p", "go"), ("p", "near"), ("p", "run"), ("q", "only")]
    siblings = near.withColumnRenamed("node_id", "of").join(nodes, "parent_id").select("node_id", "name", "fn_key")
    calls = ['require("mod").only', "require 'gone'.f", "al.only", "ext.f", "M.go", "M.none", "near", "run", "imp", "impx", "only", "twin", "nowhere", "x.y"]
    raw = spark.createDataFrame([("a", i, c, "a#main", i) for i, c in enumerate(calls)] + [("a", 99, "run", None, 1)], "node_id string, seq int, callee string, from_fn string, line int")
    aliases = spark.createDataFrame([("a", "al", "c", "mod"), ("a", "ext", None, "lib")], "node_id string, alias string, target string, module string")
    imports = spark.createDataFrame([("a", "imp", "c", "mod", "only"), ("a", "impx", None, "lib", "g")], "node_id string, name string, target string, module string, member string")
    got = R.resolve_calls(raw, fns, aliases, True, spark.createDataFrame([("mod", "c")], "module string, node_id string"), siblings, imports)
    assert {r.callee: (r.rung, r.to_key, r.alias_module, r.member) for r in got.collect()} == {
        'require("mod").only': ("inline", "c#only", None, None), "require 'gone'.f": ("external", None, "gone", "f"), "al.only": ("alias", "c#only", None, None), "ext.f": ("external", None, "lib", "f"),
        "M.go": ("own", "a#go", None, None), "M.none": ("own", None, None, None), "near": ("own", "a#near", None, None), "run": ("sibling", "b#run", None, None), "imp": ("import", "c#only", None, None),
        "impx": ("external", None, "lib", "g"), "only": ("unique", "c#only", None, None), "twin": (None, None, None, None), "nowhere": (None, None, None, None), "x.y": (None, None, None, None)}
    assert rows(R.external_calls(got)) == [("a", "gone", "f", 1), ("a", "lib", "f", 1), ("a", "lib", "g", 1)]


def test_results_log_is_one_document(spark):
    found = spark.createDataFrame([("warn", "missing-summary", "n1", None), ("error", "missing-module-tag", "n2", None), ("info", "missing-readme", None, None)], "severity string, check string, node_id string, detail string")
    log = "".join(r.text for r in K.exchange_log(C.all_of(found)).orderBy("part", "at").collect())
    run = json.loads(log)["runs"][0]
    assert [x["id"] for x in run["tool"]["driver"]["rules"]] == ["missing-module-tag", "missing-readme", "missing-summary"]
    assert [(x["ruleId"], x["level"], "locations" in x) for x in run["results"]] == [("missing-module-tag", "error", True), ("missing-readme", "note", False), ("missing-summary", "warning", True)]
    empty = "".join(r.text for r in K.exchange_log(C.all_of(found).limit(0)).orderBy("part", "at").collect())
    assert json.loads(empty)["runs"][0]["results"] == []


def test_roots_and_revisions(spark, tmp_path):
    n = spark.createDataFrame([("x", None, 0), ("y", "x", 1)], "node_id string, parent_id string, depth int")
    assert rows(X.multi_root({"a": n})) == [(".", None, 0), ("a:x", ".", 1), ("a:y", "a:x", 2)]
    assert rows(G.tree_walk(spark.createDataFrame([("r", None, 0), ("b", "r", 2), ("a", "r", 3), ("c", "b", 1)], "node_id string, parent_id string, ord int"), spark.createDataFrame([("r",)], "node string"), 3)) == [("a", 1), ("b", 1), ("r", 0)]
    a = spark.createDataFrame([("abc1", 1), ("abd2", 2), ("abc1", 3)], "rev string, n int")
    assert rows(S_FILES.at_revision(a, "abc")) == [("abc1", 1), ("abc1", 3)]
    for rev in ("ab", "zz"):
        with pytest.raises(ValueError):
            S_FILES.at_revision(a, rev)
    for who in ("one", "two"):
        folder = tmp_path / who / "docs" / "map"
        folder.mkdir(parents=True)
        (folder / "module_map.json").write_text(json.dumps({"nodes": [{"id": who + ".m"}]}))
    assert rows(S_FILES.consumers(spark, str(tmp_path)).select("consumer", "ord", "id")) == [("one", 0, "one.m"), ("two", 0, "two.m")]


def test_routes_and_names(spark):
    with pytest.raises(ValueError, match="not a commit's name"):
        registry.answer(spark, "", "commit/; rm")
    with pytest.raises(ValueError, match="no such route"):
        registry.answer(spark, "", "nothing")
    with pytest.raises(ValueError, match="no such tool"):
        registry.call(spark, "", "nothing")

    @registry.route("own")
    def own(s, sf_dir):
        return s.range(3)

    assert registry.answer(spark, "", "own").count() == 3 and registry.listed(spark).where("name = 'own'").count() == 1
    one = spark.range(1)
    get = lambda c: one.select(c).head()[0]
    lit = S.F.lit
    assert get(S.percent_decoded(lit("a%20b+c"))) == "a b c" and get(S.percent_decoded(lit("100%"))) == "100%"
    assert get(S.safe_sha(lit("ABCDEF1"))) == "abcdef1" and get(S.safe_sha(lit("../x"))) is None and get(S.static_name(lit(".x"))) is None and get(S.static_name(lit("a-b.js"))) == "a-b.js"


def test_evidence_and_collisions(spark):
    d = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1)], "g string, v int")
    got = A.evidence(d, "g", "v", 3)
    assert rows(got) == [("a", 1, 0, 30), ("a", 2, 1, 30), ("a", 3, 2, 30), ("b", 1, 1, 1)]
    assert {(r.g, r.n, r.collides) for r in A.collisions(d, ["g"]).collect()} == {("a", 30, True), ("b", 1, False)}


def test_walks_raise_at_their_bound(spark, monkeypatch):
    monkeypatch.setattr(G, "ROUNDS", 3)
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string")
    with pytest.raises(RuntimeError):
        G.walk(chain, spark.createDataFrame([("0",)], "node string"))
    assert G.walk(chain, spark.createDataFrame([("0",)], "node string"), 2).count() == 3


def test_handle_and_bursts_on_a_stream(spark, tmp_path):
    """A stream of changed files: subscribers hear each batch, bursts are counted when their gap has passed."""
    from sparkloom.streaming import watch as T

    source = tmp_path / "in"
    spark.createDataFrame([("a.lua", "2024-01-01 00:00:00"), ("b.lua", "2024-01-01 00:00:00.2"), ("a.lua", "2024-01-01 00:00:05")], "path string, ts string").selectExpr("path", "cast(ts as timestamp) ts").write.parquet(str(source))
    heard = []
    handle = T.Handle("changed_files", spark)
    undo = handle.on_change(lambda batch, i: heard.append((i, batch.count())))
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(source))
    query = stream.writeStream.foreachBatch(handle.refresh).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert heard == [(0, 3)] and rows(spark.table("changed_files").selectExpr("path", "second(ts)")) == [("a.lua", 5), ("b.lua", 0)]
    undo()
    handle.refresh(spark.createDataFrame([("c.lua", "2024-01-02 00:00:00"), ("a.lua", "2023-01-01 00:00:00")], "path string, ts string").selectExpr("path", "cast(ts as timestamp) ts"), 1)
    assert len(heard) == 1 and rows(spark.table("changed_files").selectExpr("path", "year(ts)")) == [("a.lua", 2024), ("b.lua", 2024), ("c.lua", 2024)]
    assert [tuple(r)[-1] for r in T.debounced(spark.read.parquet(str(source))).orderBy("started").collect()] == [2, 1]
    sink = T.debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    sink.awaitTermination()
    assert spark.table("bursts").columns == ["started", "ended", "events"]


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    """Bytes written follow the batch; another handle goes on from the state; a batch that comes again changes nothing."""
    from sparkloom.session import listed
    from sparkloom.streaming import watch as T

    state = f"file://{tmp_path}/state"
    batch = lambda names, second: spark.createDataFrame([(n, second) for n in names], "path string, s int").selectExpr("path", "timestamp_seconds(s) AS ts", "'x' AS note")
    handle = T.Handle("state_of_files", spark, buckets=8, state=state)
    handle.refresh(batch([f"f{k}" for k in range(200)], 10), 0)
    assert len(listed(spark, f"{state}/rows-1")) == 8 and spark.table("state_of_files").count() == 200
    handle.refresh(batch(["f7"], 20), 1)
    assert len(listed(spark, f"{state}/rows-2")) == 1
    again = T.Handle("state_of_files", spark, buckets=8, state=state)
    found = lambda: rows(spark.table("state_of_files").selectExpr("path", "unix_seconds(ts)"))
    want = sorted([(f"f{k}", 20 if k == 7 else 10) for k in range(200)])
    assert found() == want
    again.refresh(batch(["f7"], 20), 1)
    again.refresh(batch(["f8"], 5), 2)
    assert found() == want
    again.refresh(batch(["new"], 5), 3)
    again.refresh(batch([], 5), 4)
    assert len(found()) == 201


def test_bursts_in_slices_are_those_of_sessions(spark):
    import random

    from sparkloom.streaming import watch as T

    r = random.Random(1)
    times, at = [], 0
    for _ in range(400):
        at += r.choice((0, 100, 499, 500, 501, 900, 2500))
        times.append(at)
    events = spark.createDataFrame([(t,) for t in times] + [(None,)], "ms long").selectExpr("timestamp_millis(ms) AS ts")
    for seconds in (1, 7, 3600):
        assert rows(T.debounced_in_slices(events, 500, seconds)) == rows(T.debounced(events.where("ts is not null")))
    assert T.debounced_in_slices(events.limit(0)).collect() == []


def test_tokens_know_comments_from_strings(spark):
    text = 'a = "x -- TODO: no" -- FIX(me): one  TODO: two\n--[==[ HACK: in\n ]] NOTE: still ]==] b.run(run)\nlocal s = [[ -- BUG: no\n]] -- run: no mark\n--[[ open TODO: t\nrun'
    files = spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "node_id string, content string")
    found = X.tokens(files)
    got = rows(X.comment_markers(found).select("line", "nth", "word", "author", "text"))
    assert got == [(1, 0, "FIX", "me", "one"), (1, 1, "TODO", None, "two"), (2, 0, "HACK", None, "in"), (3, 0, "NOTE", None, "still"), (6, 0, "TODO", None, "t")]
    fns = spark.createDataFrame([("f", "f#1", "M.run"), ("f", "f#2", "s"), ("g", "g#1", "run")], "node_id string, fn_key string, fn_name string")
    assert rows(X.local_refs(fns, found)) == [("f", "f#1", 2), ("f", "f#2", 0), ("g", "g#1", 0)]
    c = spark.createDataFrame([("f", 'int a; // TODO: x\nchar *s = "// no"; /* NOTE: y\n FIX: z */')], "node_id string, content string")
    assert rows(X.comment_markers(X.tokens(c, "braces")).select("line", "word", "text")) == [(1, "TODO", "x"), (2, "NOTE", "y"), (3, "FIX", "z")]


def test_types_are_split_outside_brackets(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(S.F.col("v")).alias("x")).head()["x"]
    assert tuple(one(S.param_info, "cb? fun(a: table<string, X[]>, b: { c: int }): Y the text")) == ("cb", "fun(a: table<string, X[]>, b: { c: int }):", True, "Y the text")
    assert tuple(one(S.param_info, "x")) == ("x", "", False, "") and tuple(one(S.param_info, "o Opts? what it")) == ("o", "Opts", True, "what it")
    assert tuple(one(S.return_info, "table<string, int> out  the map")) == ("table<string, int>", "out", "the map")
    assert tuple(one(S.return_info, "int")) == ("int", None, "")
    over = one(S.overload_info, "fun(a: fun(x: T<A, B>): U, b?: int, string): R, { x: int, y: int }")
    assert [tuple(x) for x in over["params"]] == [("a", "fun(x: T<A, B>): U", False), ("b", "int", True), ("_", "string", False)] and over["returns"] == ["R", "{ x: int, y: int }"]
    for bad in ("text", "fun(a: b", "fun"):
        assert one(S.overload_info, bad) == ([], [])
    assert one(S.overload_info, "fun()") == ([], [])


def test_rules_of_ones_own_and_self(spark):
    fns = spark.createDataFrame([("n", "1", "T:m", ["a"], ["self", "a"]), ("n", "2", "T.m", ["self", "a"], ["a"]), ("n", "3", "T.m", ["a"], ["b"]), ("n", "4", "T.m", ["self", "a"], ["self", "b"]), ("n", "5", "f", ["..."], ["x"])], "node_id string, fn_key string, fn_name string, declared array<string>, params array<string>")
    assert [r.detail for r in C.param_mismatch(fns).orderBy("detail").collect()] == ["3", "4"]

    @C.check("short-name")
    def short(f):
        return C.finding(f.where("length(fn_name) < 2"), "info", "short-name", detail="fn_name")

    try:
        assert rows(C.all_of(C.param_mismatch(fns), *C.extra(fns)).select("check", "detail")) == [("param-name-mismatch", "3"), ("param-name-mismatch", "4"), ("short-name", "f")]
    finally:
        C.EXTRA.pop("short-name")
