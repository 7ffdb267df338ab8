"""The driver's relational tables read as a code base: adapters in SQL that Spark and DuckDB both run.

Suppliers are modules, nations and regions their folders, parts functions, orders commits, consecutive lines of an order
calls, events calls at run time. Each line is a require too: of its supplier's half (lines 4 and 5) or third (6 and 7), or of
the next in a ring of up to six (1 to 3; of its half where it is on none). So every row counts, yet the graph is sparse: rings of several sizes, paths as
long as the logarithm of the suppliers, blocks that stand apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import stored

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark", "conversations")

#: Their files are so compact that Spark, which judges by a file's size, would broadcast a million rows through the driver.
COMPACT = ("part",)

#: name -> (SQL, tables it reads), in an order in which each reads earlier ones only.
SQL: dict[str, str] = {
    "modules": """SELECT s_suppkey AS k, s_name AS node_id, 'pkg.' || lower(r_name) || '.' || lower(n_name) || '.s' || CAST(s_suppkey AS STRING) AS module,
        lower(r_name) || '/' || lower(n_name) || '/s' || CAST(s_suppkey AS STRING) || CASE s_suppkey % 3 WHEN 0 THEN '.lua' WHEN 1 THEN '.py' ELSE '.ts' END AS path,
        CASE s_suppkey % 3 WHEN 0 THEN 'lua' WHEN 1 THEN 'python' ELSE 'typescript' END AS language, n_name AS parent_id, s_acctbal AS size,
        CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'Handles ' || lower(n_name) || ' orders of s' || CAST(s_suppkey AS STRING) END AS summary
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "nodes": """SELECT '.' AS node_id, CAST(0 AS BIGINT) AS ord, 'namespace' AS kind, '.' AS name, '' AS path, CAST(NULL AS STRING) AS language, CAST(NULL AS STRING) AS module, CAST(NULL AS STRING) AS summary, CAST(NULL AS STRING) AS parent_id, 0 AS depth
        UNION ALL SELECT r_name, CAST(1 + r_regionkey AS BIGINT), 'namespace', lower(r_name), lower(r_name), NULL, NULL, NULL, '.', 1 FROM region
        UNION ALL SELECT n_name, CAST(100 + n_nationkey AS BIGINT), 'namespace', lower(n_name), lower(r_name) || '/' || lower(n_name), NULL, NULL, NULL, r_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT node_id, CAST(1000 + k AS BIGINT), 'module', 's' || CAST(k AS STRING), path, language, module, summary, parent_id, 3 FROM modules""",
    "steps": """SELECT o, line, s, p, flag, p2, seq, CASE WHEN t = s OR CAST(floor(s / 8) AS BIGINT) % 4 <> CAST(floor(t / 8) AS BIGINT) % 4 AND (CAST(floor(s / 8) AS BIGINT) % 4 = 3 OR CAST(floor(t / 8) AS BIGINT) % 4 = 3) THEN CAST(NULL AS BIGINT) ELSE t END AS s2
        FROM (SELECT *, CASE WHEN line > 5 THEN CAST(floor(s / 3) AS BIGINT) WHEN line > 3 THEN CAST(floor(s / 2) AS BIGINT) WHEN s >= 8 AND s % 8 < 1 + CAST(floor(s / 8) AS BIGINT) % 6 THEN s - s % 8 + (s % 8 + 1) % (1 + CAST(floor(s / 8) AS BIGINT) % 6) ELSE CAST(floor(s / 2) AS BIGINT) END AS t
        FROM (SELECT l_orderkey AS o, l_linenumber AS line, l_suppkey AS s, l_partkey AS p, l_returnflag AS flag, lead(l_partkey) OVER w AS p2, l_orderkey * 100 + row_number() OVER w AS seq
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) x) y""",
    "requires_raw": """SELECT a.node_id, seq, CASE WHEN p % 11 = 0 THEN 'ext.lib' || CAST(p % 4 AS STRING) ELSE b.module END AS module, (a.k + line) % 3 = 0 AS deferred, line
        FROM steps JOIN modules a ON s = a.k JOIN modules b ON s2 = b.k""",
    "links": """SELECT DISTINCT a.node_id AS src, b.node_id AS dst, a.k AS k, line FROM steps JOIN modules a ON s = a.k JOIN modules b ON s2 = b.k WHERE p % 11 <> 0""",
    "edges": """SELECT DISTINCT src, dst FROM links""",
    "fns": """SELECT node_id, fn_name, fn_key, language, k, complexity, line, CASE WHEN k % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE line + complexity - 1 END AS line_end, shape, shape_size, tested, internal, documented, summary, calls_hint, kind
        FROM (SELECT m.node_id, CASE WHEN p_partkey % 4 = 0 THEN 'helper' || CAST(p_partkey AS STRING) ELSE m.module || '.f' || CAST(p_partkey AS STRING) END AS fn_name,
        m.node_id || '#f' || CAST(p_partkey AS STRING) AS fn_key, m.language, p_partkey AS k, CAST(p_size AS BIGINT) AS complexity,
        CAST(sum(p_size) OVER (PARTITION BY m.node_id ORDER BY p_partkey) - p_size + 1 AS BIGINT) AS line, p_name AS shape, CAST(p_size * 2 AS BIGINT) AS shape_size,
        p_partkey % 3 = 0 AS tested, p_type = 'PROMO' AS internal, p_partkey % 2 = 0 AND p_type <> 'PROMO' AS documented,
        CASE WHEN p_partkey % 2 = 0 THEN 'Makes a ' || p_name ELSE '' END AS summary, p_retailprice AS calls_hint, p_type AS kind
        FROM (SELECT *, p_partkey % (SELECT count(*) FROM supplier) AS mk FROM part) p JOIN modules m ON p.mk = m.k) x""",
    "calls": """SELECT DISTINCT a.node_id AS src, a.fn_name AS from_fn, a.fn_key AS from_key, b.node_id AS dst, b.fn_name AS to_fn, b.fn_key AS to_key
        FROM steps JOIN fns a ON p = a.k JOIN fns b ON p2 = b.k WHERE a.k <> b.k""",
    "commits": """SELECT DISTINCT o_orderkey AS sha, CAST(o_orderdate AS DATE) AS day, o_custkey AS author, m.path FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN modules m ON l_suppkey = m.k""",
    "telemetry": """SELECT 'f' || CAST((user_id * 13 + event_id % 7) % (SELECT count(*) FROM part) AS STRING) AS name, (user_id * 13 + event_id % 7) % (SELECT count(*) FROM part) AS k, event_type, CAST(ts AS DATE) AS day, ts, value FROM events""",
    "runtime": "SELECT f.fn_key, f.node_id, count(*) AS calls FROM telemetry t JOIN fns f ON t.k = f.k GROUP BY f.fn_key, f.node_id",
    "hunks": "SELECT m.path, m.node_id, CAST(l_orderkey AS BIGINT) AS sha, CAST(l_quantity * 3 AS BIGINT) AS first, CAST(l_quantity * 3 AS BIGINT) + l_linenumber AS last FROM lineitem JOIN modules m ON l_suppkey = m.k",
    "bindings": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'n,v' WHEN event_type = 'view' THEN 'n' ELSE 'i' END AS modes, '<leader>' || CAST(user_id % 40 AS STRING) AS lhs, event_id % 9 = 0 AS buffer_local, CAST(user_id % 17 AS STRING) || ':' || CAST(event_id % 23 AS STRING) AS site FROM events",
    "markdown": """SELECT doc_id, '# Notes ' || CAST(doc_id AS STRING) || chr(10) || 'Uses `pkg.' || lower(r_name) || '.' || lower(n_name) || '.s' || CAST(k AS STRING) || '.f' || CAST(doc_id % 50 AS STRING) || '` and `helper' || CAST(doc_id % 37 AS STRING) || '` well.' || chr(10)
        || CASE doc_id % 5 WHEN 0 THEN '-- TODO: check ' || CAST(doc_id AS STRING) WHEN 1 THEN '-- FIXME(ann): bad case' WHEN 2 THEN '-- `TODO: quoted` NOTE: see above' WHEN 3 THEN 'plain text' ELSE '-- HACK: short cut' END || chr(10)
        || 'See [home](../s' || CAST(k AS STRING) || '.md#top) or [old](./gone' || CAST(doc_id % 3 AS STRING) || '.md).' AS content, path AS near
        FROM (SELECT doc_id, k, path, split_part(path, '/', 1) AS r_name, split_part(path, '/', 2) AS n_name FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM supplier) AS mk FROM documents) d JOIN modules ON d.mk = k) x""",
    "checklist": """SELECT o_orderkey AS item, 'docs/list' || CAST(o_custkey % 5 AS STRING) || '.md' AS file, o_orderkey AS line, CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE m.path END AS ref, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DATE) ELSE CAST(o_orderdate AS DATE) END AS verified, o_orderstatus = 'F' AS done
        FROM (SELECT *, o_orderkey % (SELECT count(*) FROM supplier) AS mk FROM orders) q JOIN modules m ON q.mk = m.k""",
    "luafiles": """SELECT fn_key AS node_id, k, 'local dep = require("' || language || '.dep' || CAST(k % 9 AS STRING) || '")' || chr(10) || 'local LIMIT = ' || CAST(k AS STRING) || chr(10) || 'local opts = ' || chr(123) || chr(125) || chr(10) || 'local M = ' || chr(123) || chr(125) || chr(10)
        || '--- Makes item ' || CAST(k AS STRING) || '. More is said here.' || chr(10) || '---@param a' || CAST(k % 3 AS STRING) || ' string The first.' || chr(10) || '---@see ' || fn_name || ', helper' || CAST(k % 37 AS STRING) || chr(10)
        || CASE WHEN k % 4 = 0 THEN '---@todo tidy ' || CAST(k AS STRING) || chr(10) ELSE '' END || CASE WHEN k % 7 = 0 THEN '---@deprecated use another' || chr(10) ELSE '' END || '---@example' || chr(10) || '--- run(' || CAST(k AS STRING) || ')' || chr(10)
        || 'local function go' || CAST(k AS STRING) || '(a, b)' || chr(10) || '  vim.keymap.set(' || chr(123) || ' "n", "v" ' || chr(125) || ', "<leader>' || CAST(k % 40 AS STRING) || '", dep.run)' || chr(10) || '  return dep.run(a, "x(y)")' || chr(10) || 'end' || chr(10)
        || 'vim.api.nvim_create_user_command("Do' || CAST(k % 21 AS STRING) || '", go, ' || chr(123) || chr(125) || ')' || chr(10) || CASE WHEN k % 2 = 0 THEN 'return M' ELSE 'return setmetatable(opts, ' || chr(123) || chr(125) || ')' END AS content FROM fns""",
    "plugins": "SELECT p_partkey AS id, p_brand || '/' || CAST(p_size AS STRING) AS repo, p_partkey % 3 = 0 AS lazy, CASE WHEN p_partkey % 4 = 1 THEN p_type || ',' || p_brand WHEN p_partkey % 4 = 2 THEN p_type ELSE '' END AS trigger_list FROM part",
    "extends": "SELECT c_custkey AS k, 'C' || CAST(c_custkey AS STRING) AS src, 'C' || CAST(CAST(floor(c_custkey / 5) AS BIGINT) * 2 AS STRING) AS dst FROM customer WHERE c_custkey % 5 > 1",
    "requests": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, url FROM pages",
}

#: Sources of several shapes, written out of parts and documents: # stands for the key, | for a line break, [[ and ]] for braces, @ for a back tick.
CODE = {
    "c": "/* Makes item #. */|int make_#(int a, char *b)|[[|  if (a && b) [[ return a; ]]|  return 0;|]]|static void help_#(void)|[[|  log(\"]]\");|]]|",
    "java": "package p;|public class T# [[|  /** Makes item #. */|  ~AOverride|  public int make(int a, String b) [[|    if (a > 0 && b != null) [[ return a; ]]|    return 0;|  ]]|  private void help() [[|    log(\"]]\");|  ]]|]]|",
    "go": "package p||// Makes item #.|func Make#(a int, b string) int [[|  if a > 0 && b != \"\" [[ return a ]]|  return 0|]]|func help() [[|  log(\"]]\")|]]|",
    "lua": "-- Makes item #.|function M.make_#(a, b)|  if a and b then return a end|  return 0|end|local function help()|  log(\"end\")|end|",
    "python": "def make_#(a, b):|    \"\"\"Makes item #.\"\"\"|    if a and b:|        return a|    return 0|||def _help():|    log(\"x\")|",
    "ruby": "class T#|  # Makes item #.|  def make(a, b)|    return a if a && b|    0|  end|  private|  def help|    log(\"end\")|  end|end|".replace("  # Makes", "  %% Makes"),
}


def _written(template: str, key: str) -> str:
    """An expression of both dialects that fills a template."""
    marks = {"[[": "chr(123)", "]]": "chr(125)", "|": "chr(10)", "@": "chr(96)", "#": f"CAST({key} AS STRING)", "%%": "'#'", "~A": "'@'", "~O": "'||'", "~K": "'[]'", "~[": "'[['", "~]": "']]'"}
    return "'" + re.sub("|".join(map(re.escape, sorted(marks, key=len, reverse=True))), lambda m: f"' || {marks[m[0]]} || '", template) + "'"


SQL |= {
    "codefiles": "SELECT p_partkey AS k, 'file' || CAST(p_partkey AS STRING) AS node_id, CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CODE)) + " END AS language, CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {_written(t, 'p_partkey')}" for i, t in enumerate(CODE.values())) + " END AS content FROM part",
    "fenced": "SELECT doc_id, " + _written("a @one@ and @@two @x@ b@@ |", "doc_id") + " || CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {_written(t, 'doc_id')}" for i, t in enumerate(("@@@lua|@no@|~~~~|@no2@|@@@", "~~~~|@no@|@@@|~~~|@no3@|~~~~ |", "@@@@|@@@|@no@|@@@@@", "plain"))) + " END || " + _written("|then @ f# @ ends|%%%% Part # of it|- one|* two|tab: true|", "doc_id") + " || CASE WHEN doc_id % 7 = 0 THEN " + _written("|@@@|@never@", "doc_id") + " ELSE '' END AS content FROM documents",
    "classdocs": "SELECT p_partkey AS k, 'types' || CAST(p_partkey AS STRING) AS node_id, '---@class C' || CAST(p_partkey AS STRING) || ' : C' || CAST(p_partkey % 7 AS STRING) || ', Base' || chr(10) || '---@field a C' || CAST(p_partkey % 5 AS STRING) || '[] the first' || chr(10) || '---@field b string|D.e' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '---@field c table<string, C1>' ELSE '' END || chr(10) || 'local x = 1' AS content FROM part",
    "signatures": "SELECT p_partkey AS k, 'sig' || CAST(p_partkey AS STRING) AS node_id, 'local M = 1' || chr(10) || CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {_written(t, 'p_partkey')}" for i, t in enumerate(("---~Aparam cb? fun(a: table<string, X#~K>, b: int)~OY# The (call|---~Areturn P<A#, B>? out  The one (#)|function M.go#(cb)|", "---~Aparam self T#|---~Aparam b [[x: int, y: P#]] Opts of it|function M:go#(b)|", "---~Aparam c T#?|function M.go#(self, c)|", "---~Aparam x number|---~Areturn|function M.go#(y, ...)|", "---~Aoverload fun(a: string, b?: table<string, int>, fun(z: Q#)): int, R<A, #>|---~Aoverload broken(#|function M.go#(a, b, c)|", "--- Does #.|function M.go#(a, b)|"))) + " END AS content FROM part",
    "commented": "SELECT p_partkey AS k, 'noted' || CAST(p_partkey AS STRING) AS node_id, CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {_written(t, 'p_partkey')}" for i, t in enumerate(("local x = \"-- TODO: no #\"|--~[ FIXME(ann): block #|  and FIX : two  HACK: three|~] local y = run#|-- NOTE: a TODO(b): b#|", "function run#(a)|  return run#(a - 1) -- WARN: deep|end|local t = [[ run# ]]|-- plain line, NOTODO: no|", "-- text only|local s = ~[ TEST: no|run# ~] .. \"BUG: no\"|local function run#() end|", "call(run#) -- PERF(x): slow # XXX:|-- run# INFO|local function run#() end|"))) + " END AS content FROM part",
    "specfiles": "SELECT p_partkey AS k, 'spec' || CAST(p_partkey AS STRING) AS node_id, " + _written("return [[|  -- [[ \"no/no\" ]]|  [[ \"own/p#\", lazy = ", "p_partkey") + " || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || " + _written(", event = [[ \"A#\", \"B\" ]], dependencies = [[ \"dep/d#\" ]] ]],|  [[ src = \"https://h.example/x/y#\", cmd = \"Do#\", keys = [[ [[ \"<leader>#\", \"x\" ]], [[ \"gq\" ]] ]] ]],|]]|", "p_partkey") + " AS content FROM part",
}


def with_clause(recursive: bool = False) -> str:
    """All adapters as common table expressions."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{k} AS ({v})" for k, v in SQL.items())


class Tables:
    """The adapters over the tables in a folder; attributes are DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._made[name] = found.hint("merge") if name in COMPACT else found
            elif name == "calls":
                self._made[name] = self._calls()
            elif name in SQL:
                used = self._used(SQL[name])
                self._made[name] = self.spark.sql(self._filled(SQL[name], used), **{k: getattr(self, k) for k in used})
            else:
                raise AttributeError(name)
        return self._made[name]

    def call_keys(self) -> DataFrame:
        """(p, p2): the keys of consecutive lines' parts where they differ, each pair once.

        Three columns are sorted: what else the SQL sorts by follows the part, so it can't change which part comes next.
        Pairs lie by p, so that they are made distinct and joined by p after one exchange.
        """
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
        pairs = self.lineitem.select(F.col("l_partkey").alias("p"), F.lead("l_partkey").over(order).alias("p2"))
        return pairs.where("p <> p2").repartition("p").distinct()

    def _calls(self) -> DataFrame:
        """The rows of the SQL, made distinct as pairs of keys: a function's key ends in its part's, so names follow from keys."""
        named = self.fns.select("k", "node_id", "fn_name", "fn_key").distinct()
        return self.calls_named(named, ("src", "from_fn", "from_key"), ("dst", "to_fn", "to_key"))

    def calls_named(self, named: DataFrame, one: tuple[str, ...], two: tuple[str, ...]) -> DataFrame:
        """(one, two): calls between functions named (k, ...)."""
        return self.call_keys().join(named.toDF("p", *one), "p").join(named.toDF("p2", *two), "p2").select(*one, *two)

    def kept(self, name: str) -> DataFrame:
        """An adapter that a query reads more than once: written down, so it is made once."""
        if not hasattr(getattr(self, name), "_loom_path"):
            self._made[name] = stored(getattr(self, name), name)
        return self._made[name]

    @staticmethod
    def _used(text: str) -> list[str]:
        return [k for k in (*BASE, *SQL) if re.search(rf"(?:FROM|JOIN) {k}\b", text)]

    @staticmethod
    def _filled(text: str, used: list[str]) -> str:
        for k in used:
            text = re.sub(rf"(FROM|JOIN) {k}\b(?! \{{)", rf"\1 {{{k}}} {'' if re.search(rf'(?:FROM|JOIN) {k} [a-z]\b(?!\w)', text) else 'AS ' + k}", text)
        return text
