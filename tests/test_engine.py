"""Operators on small literal tables; expected rows are written out or made by plain Python."""

from pyspark.sql import functions as F

from sparkloom.functions import scalar as S
from sparkloom.operators import aggregate as A
from sparkloom.operators import checks as C
from sparkloom.operators import extract as X
from sparkloom.operators import graph as G
from sparkloom.operators import resolve as R
from sparkloom.operators import search as Q
from sparkloom.sources import lexers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_walks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert rows(G.walk(e, seed)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(G.walk(e, seed, 1)) == [("a", 0), ("b", 1)]
    assert {r[0] for r in rows(G.impact(e, spark.createDataFrame([("d",)], "node string")))} == {"a", "b", "c", "e"}
    assert rows(G.cycles(e)) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert rows(G.shortest_path(e, "a", "d")) == [(1, "a", "b"), (2, "b", "c"), (3, "c", "d")]
    assert G.shortest_path(e, "d", "a").isEmpty()
    assert dict(rows(G.layers(e)))["d"] == 1


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert G.cycles(e).isEmpty() and G.layers(e).isEmpty()


def test_require_line_rule(spark):
    got = spark.createDataFrame([("a", "b", 1, "m", False, 9), ("a", "b", 2, "m", True, 2), ("a", "b", 3, "m", False, 5), ("a", "a", 4, "m", False, 1)], "node_id string, dst string, seq int, module string, deferred boolean, line int")
    assert rows(R.require_edges(got)) == [("a", "b", False, 5, "m", 3)]


def test_relative_requires(spark):
    nodes = spark.createDataFrame([("n1", 1, "src/a.js", None), ("n2", 2, "src/lib/index.js", None), ("n3", 3, "x.lua", "x")], "node_id string, ord int, path string, module string")
    raw = spark.createDataFrame([("n1", 1, "./lib", False, 1), ("n1", 2, "x", False, 2), ("n1", 3, "lib", False, 3)], "node_id string, seq int, module string, deferred boolean, line int")
    assert {(r.module, r.dst) for r in R.resolve_requires(raw, nodes).collect()} == {("./lib", "n2"), ("x", "n3"), ("lib", None)}


def test_calls_do_not_fall_through(spark):
    fns = spark.createDataFrame([("n1", "go", "n1#go", 1), ("n2", "M.run", "n2#run", 2)], "node_id string, fn_name string, fn_key string, k int")
    alias = spark.createDataFrame([("n1", "m", "n2", "mod"), ("n1", "ext", None, "other")], "node_id string, alias string, target string, module string")
    raw = spark.createDataFrame([("n1", 1, "m.run", "n1#go", 1), ("n1", 2, "m.go", "n1#go", 2), ("n1", 3, "ext.f", "n1#go", 3), ("n1", 4, "run", "n1#go", 4), ("n1", 5, "go", "n1#go", 5)], "node_id string, seq int, callee string, from_fn string, line int")
    got = R.resolve_calls(raw, fns, alias, guess=True)
    assert {(r.callee, r.rung, r.to_key, r.confidence) for r in got.collect()} == {("m.run", "alias", "n2#run", "exact"), ("m.go", "alias", None, "exact"), ("ext.f", "external", None, "exact"), ("run", "unique", "n2#run", "heuristic")}
    assert rows(R.external_calls(got)) == [("n1", "other", "f", 1)]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).head()[0]
    assert get(S.normalised(F.lit("a/b/../c/./d"))) == "a/c/d"
    assert get(S.pct(F.lit(1), F.lit(3))) == 33.3 and get(S.pct(F.lit(1), F.lit(0))) == 0.0
    assert get(S.route_path(F.lit("https://h.example/x/1?q=2#f"))) == "/x/1" and get(S.route_path(F.lit("{{base}}"))) == "/"
    assert get(S.summary_of(F.lit("First one. Second.\n\nMore"))) == "First one."
    assert get(F.regexp_like(F.lit("/en/5"), S.route_pattern(F.lit("/en/:id"))))


def test_markers_and_ledgers(spark):
    f = spark.createDataFrame([("a", "-- TODO(ann): one\n-- `FIXME: no` NOTE: two\nTODOS: no\n-- todo: no")], "node_id string, content string")
    assert [(r.line, r.kind, r.author, r.text) for r in X.markers(f).orderBy("line").collect()] == [(1, "TODO", "ann", "one"), (2, "NOTE", None, "two")]
    c = spark.createDataFrame([("m", "## Keys\n- [x] done @ref src/a.lua:32 @verified 2026-08-08\n* [ ] open")], "node_id string, content string")
    got = X.checklist_items(c).orderBy("line").collect()
    assert [(r.section, r.done, r.ref, r.ref_line, str(r.verified)) for r in got] == [("Keys", True, "src/a.lua", 32, "2026-08-08"), ("Keys", False, None, None, "None")]


def test_lexers(spark):
    files = [("p", "python", "def f(a, b):\n    '''Adds.'''\n    if a and b:\n        return 1\n"), ("l", "lua", "-- Runs it\nlocal function go(x)\n  if x then\n    return 1\n  end\nend\n"), ("g", "go", "func Add(a int, b int) int {\n\treturn a + b\n}\n"), ("bad", "python", "def (")]
    got = {r.node_id: r for r in lexers.functions(spark.createDataFrame(files, "node_id string, language string, content string")).collect()}
    assert set(got) == {"p", "l", "g"}
    assert (got["p"].fn_name, got["p"].params, got["p"].complexity, got["p"].summary) == ("f", ["a", "b"], 3, "Adds.")
    assert (got["l"].fn_name, got["l"].line, got["l"].line_end, got["l"].summary) == ("go", 2, 6, "Runs it")
    assert (got["g"].fn_name, got["g"].line_end, got["g"].params) == ("Add", 3, ["a", "b"])


def test_filter_language():
    assert Q.terms('One -two "three four"') == [(True, "one"), (False, "two"), (True, "three four")]


def test_checks_fire_and_stay_silent(spark):
    n = spark.createDataFrame([("a", "module", "x.a", "x/a.lua", "", "p"), ("b", "module", "x.b", "x/b.lua", "Does.", "p")], "node_id string, kind string, module string, path string, summary string, parent_id string")
    e = spark.createDataFrame([("b", "a")], "src string, dst string")
    got = C.all_of(C.missing_summary(n), C.unreferenced(n, e), C.module_path_mismatch(n))
    assert [(r.check, r.node_id) for r in C.ordered(got).collect()] == [("unreferenced-module", "b"), ("missing-summary", "a")]
    assert C.gate(n, n, got) and not C.gate(n, n.limit(1), got)


def test_verdicts(spark):
    v = spark.createDataFrame([("doc_coverage", 85.0), ("test_coverage", 50.0), ("duplicates", 3.0)], "probe string, value double")
    assert {(r.probe, r.verdict, r.distance) for r in A.judged(v).collect()} == {("doc_coverage", "good", 5.0), ("duplicates", "bad", 2.0)}


def test_queries_have_unique_columns_and_rows():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


LUA = """local dep = require("a.dep")
local N = 5
local M = {}
--- First one. Second.
---@param a string
---@see x.y, z
---@todo later
---@example
--- go(1)

local function go(a)
  vim.keymap.set({ "n", "v" }, "<leader>k", dep.run)
  mymap("i", "<c-x>", function() end)
  -- dep.gone()
  return dep.run(a, "x(y)")
end
go(2)
return setmetatable(M, {})"""


def test_lua_extractors(spark):
    f = spark.createDataFrame([("f", LUA), ("e", "")], "node_id string, content string")
    assert [(r.owner, r.line, r.tag, r.value) for r in X.doc_tags(f).orderBy("line").collect()] == [
        (10, 4, "prose", "First one. Second."), (10, 5, "param", "a string"), (10, 6, "see", "x.y, z"), (10, 7, "todo", "later"), (10, 8, "example", "go(1)")]
    one = X.doc_blocks(X.doc_tags(f)).collect()
    assert [(r.summary, r.params, r.see, r.todo, r.bug, r.deprecated, r.internal, r.example) for r in one] == [("First one.", ["a"], ["x.y", "z"], ["later"], [], None, False, "go(1)")]
    assert rows(X.symbols(f).select("line", "name", "kind", "detail")) == [(2, "N", "constant", "5")]
    assert rows(X.export_name(f)) == [("e", None), ("f", "M")]
    assert rows(X.export_shapes(f)) == [("e", "none"), ("f", "call")]
    assert rows(X.bindings(f, {"mymap": "vim.keymap.set"}).select("kind", "modes", "lhs")) == [("keymap", "i", "<c-x>"), ("keymap", "n,v", "<leader>k")]
    spans = spark.createDataFrame([("f", "f#go", 11, 16), ("f", "f#inner", 12, 13)], "node_id string, fn_key string, first int, last int")
    got = {(r.line, r.callee): r.from_fn for r in X.call_sites(f, spans).collect()}
    assert got == {(1, "require"): None, (12, "vim.keymap.set"): "f#go", (13, "mymap"): "f#go", (15, "dep.run"): "f#go", (17, "go"): None, (18, "setmetatable"): None}


def test_tools_and_roots(spark):
    f = spark.createDataFrame([("t", '{"tools": [{"name": "rg", "command": "rg -n"}, "odd", {"command": "x"}]}'), ("bad", "{")], "node_id string, content string")
    got = X.tools(f)
    assert {(r.name, r.command) for r in got.collect()} == {("rg", "rg -n"), (None, "x"), (None, None)}
    log = spark.createDataFrame([("\x1eab\x1f2024-01-02\n\nx.lua\nx.lua\n\x1ebroken\ny.lua\n",)], "content string")
    assert [(r.sha, str(r.day), r.path) for r in X.log_commits(log).orderBy("path").collect()] == [("ab", "2024-01-02", "x.lua"), ("broken", "None", "y.lua")]
    assert C.invalid_tools(got).count() == 2
    roots = spark.createDataFrame([("lua",), ("lua/a",), ("src",), ("source",)], "path string")
    assert rows(X.uncovered_roots(roots)) == [("lua",), ("source",), ("src",)]
    assert rows(X.uncovered_roots(spark.createDataFrame([(".",), ("a",)], "path string"))) == [(".",)]


def test_views(spark):
    from sparkloom.operators import views as V

    e = spark.createDataFrame([("a", "b", False), ("b", "c", True)], "src string, dst string, deferred boolean")
    assert rows(V.why(e, "a", "c")) == [(1, "a", "b", False, True), (2, "b", "c", True, True)]
    assert rows(V.drawn_layers(e, spark.createDataFrame([("b",)], "node string"))) == [("a", 0, False), ("b", 1, False), ("c", 2, False)]
    assert rows(V.drawn_layers(e, spark.createDataFrame([("b",)], "node string"), most=2)) == [("b", 0, True), ("c", 1, True)]
    fam = V.families(spark.createDataFrame([("dog", "animal"), ("pup", "dog"), ("x", "y"), ("y", "x")], "src string, dst string"))
    assert rows(fam) == [("animal", "animal", 0), ("dog", "animal", 1), ("pup", "animal", 2), ("x", "x", 0), ("y", "x", 0)]
    words = spark.createDataFrame([("string.format.x",), ("end",), ("s:rep",), ("no.end",), ("",)], "word string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert rows(V.glossary(words, keys("string", "string.format", "string.rep"), keys("end"), "string")) == [("end", "end", "keyword"), ("s:rep", "string.rep", "stdlib"), ("string.format.x", "string.format", "stdlib")]
    p = spark.createDataFrame([("r/a", True, []), ("r/a", False, ["cmd"]), ("r/b", False, [])], "repo string, lazy boolean, triggers array<string>")
    assert rows(V.load_states(p).select("repo", "state", "twice")) == [("r/a", "ondemand", True), ("r/a", "trigger", True), ("r/b", "startup", False)]
    fn = spark.createDataFrame([("useThing",), ("useless",), ("M.useX",)], "fn_name string")
    assert rows(V.hooks(fn)) == [("M.useX",), ("useThing",)]


def test_lexers_of_clauses(spark):
    files = [
        ("h", "haskell", "module A (area, Shape(..)) where\nimport Data.List\ndata X = Y\n\n-- | The area.\narea :: Double -> Double\narea r = pi * r\n\nhide x\n  | x > 1 = 1\n  | otherwise = 0\n"),
        ("o", "ocaml", "(* Adds. *)\nlet rec add a b =\n  if a = 0 then b else add (a - 1) b\n\nlet limit = 3\n"),
        ("e", "erlang", "-module(m).\n-export([go/2]).\n%% Runs.\n-spec go(term(), term()) -> ok.\ngo(A, [B]) when A > 1 ->\n    help(A);\ngo(_, _) ->\n    ok.\nhelp(X) ->\n    X.\n"),
        ("s", "asm", ".globl main\n; Starts.\nmain:\n    mov eax, 1\n    ret\nlocal1:\n    ret\n"),
        ("c", "scala", "object A {\n  def twice(n: Int): Int = {\n    n * 2\n  }\n}\n"),
    ]
    got = {(r.node_id, r.fn_name): (r.line, r.line_end, r.params, r.summary, r.internal) for r in lexers.functions(spark.createDataFrame(files, "node_id string, language string, content string")).collect()}
    assert got == {
        ("h", "area"): (7, 7, ["r"], "The area.", False), ("h", "hide"): (9, 11, ["x"], "", True),
        ("o", "add"): (2, 3, ["a", "b"], "Adds.", False),
        ("e", "go"): (5, 8, ["A", "[B]"], "Runs.", False), ("e", "help"): (9, 10, ["X"], "", True),
        ("s", "main"): (3, 5, [], "Starts.", False), ("s", "local1"): (6, 7, [], "", True),
        ("c", "A.twice"): (2, 4, ["n"], "", False),
    }


def test_adapters_keep_every_row(spark, tmp_path):
    """No order or line is left out of the code base, whatever its key."""
    from sparkloom.sources.adapters import Tables

    keys = [1, 2, 7, 203, 499, 500, 501]
    made = {
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
        "nation": ([(0, "CHINA", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "supplier": ([(k, f"S{k}", 0, 1.0) for k in range(3)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"),
        "orders": ([(k, 1, "2024-01-01", "F") for k in keys], "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string"),
        "lineitem": ([(k, n, n, n, "R", 1.0, 1.0, 0.0, 0.0) for k in keys for n in (0, 1)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
    }
    for name, (data, schema) in made.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = Tables(spark, str(tmp_path))
    every = sorted((k, n) for k in keys for n in (0, 1))
    assert sorted((r.o, r.line) for r in t.steps.collect()) == every
    assert sorted((r.sha, r.node_id) for r in t.hunks.collect()) == [(k, f"S{n}") for k, n in every]
    assert sorted(r.item for r in t.checklist.collect()) == keys
    assert t.requires_raw.count() == len(keys)
