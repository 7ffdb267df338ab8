"""Queries of sources in several shapes, of the call ladder, of roots and projects, and of what panels and routes show."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalar as S
from sparkloom.operators import aggregate as A
from sparkloom.operators import checks as C
from sparkloom.operators import diff as D
from sparkloom.operators import extract as X
from sparkloom.operators import graph as G
from sparkloom.operators import resolve as R
from sparkloom.operators import search as Q
from sparkloom.operators import sinks as K
from sparkloom.operators import views as V
from sparkloom.plans import registry
from sparkloom.plans.catalog import AFTER, BEFORE, FINDINGS, FOUND, SPANS, SQL, _findings, query
from sparkloom.sources import files as S_FILES
from sparkloom.sources import lexers

CODE_LINES = """cl AS (SELECT node_id, language, content, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS text FROM codefiles)"""


@query(CODE_LINES + r""", st AS (SELECT *, regexp_extract(text, '^ *(?:(?:static|public|private|local) )*(?:int|void|func|function|def) ([A-Za-z_.0-9]+)', 1) AS name, regexp_extract(text, '^( *)', 1) AS pad FROM cl),
sf AS (SELECT *, lead(line, 1, 1000000000) OVER (PARTITION BY node_id ORDER BY line) AS nxt FROM st WHERE name <> '' AND (contains(text, '(') OR language = 'ruby')), pv AS (SELECT node_id, min(line) AS pline FROM cl WHERE trim(text) = 'private' GROUP BY node_id),
en AS (SELECT sf.node_id, sf.line, CASE WHEN sf.language = 'python' THEN max(e.line) FILTER (WHERE e.text <> '' AND e.line < sf.nxt) ELSE min(e.line) FILTER (WHERE e.text = sf.pad || CASE WHEN sf.language IN ('lua', 'ruby') THEN 'end' ELSE chr(125) END) END AS line_end FROM sf JOIN cl e ON sf.node_id = e.node_id AND e.line > sf.line GROUP BY sf.node_id, sf.line, sf.language, sf.pad),
bo AS (SELECT en.node_id, en.line, en.line_end, string_agg(regexp_replace(c.text, '"[^"]*"', '', 'g'), chr(10) ORDER BY c.line) AS body FROM en JOIN cl c ON c.node_id = en.node_id AND c.line BETWEEN en.line AND en.line_end GROUP BY ALL),
pa AS (SELECT sf.*, bo.line_end, body, list_filter(string_split(regexp_extract(text, '[(](.*)[)]', 1), ','), lambda x: trim(x) <> '' AND trim(x) <> 'void') AS ps FROM sf JOIN bo ON sf.node_id = bo.node_id AND sf.line = bo.line)
SELECT node_id, CASE language WHEN 'java' THEN regexp_extract(content, 'class (T[0-9]+)', 1) || '.' || name WHEN 'ruby' THEN regexp_extract(content, 'class (T[0-9]+)', 1) || '#' || name ELSE name END AS fn_name, (line - CASE WHEN language = 'java' AND contains(content, '@Override') AND name = 'make' THEN 1 ELSE 0 END)::INT AS line, line_end::INT AS line_end,
array_to_string(list_transform(ps, lambda x: CASE language WHEN 'go' THEN regexp_extract(trim(x), '^([a-z]+)', 1) ELSE regexp_extract(trim(x), '([a-z]+)$', 1) END), ',') AS params, CASE WHEN name ILIKE '%make%' THEN regexp_extract(content, '(Makes item [0-9]+[.])', 1) ELSE '' END AS summary,
(1 + len(regexp_extract_all(body, '\b(?:if|and)\b|&&')))::INT AS complexity, CASE language WHEN 'c' THEN starts_with(text, 'static') WHEN 'java' THEN contains(text, 'private') WHEN 'go' THEN NOT regexp_matches(name, '^[A-Z]') WHEN 'lua' THEN starts_with(text, 'local') WHEN 'python' THEN starts_with(name, '_') ELSE line > pline END AS internal FROM pa LEFT JOIN pv USING (node_id)""")
def source_functions(t):
    got = lexers.functions(t.codefiles)
    return got.select("node_id", "fn_name", "line", "line_end", F.array_join("params", ",").alias("params"), "summary", "complexity", "internal")


@query(r"""lf AS (SELECT doc_id, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS text FROM fenced), ff AS (SELECT *, regexp_extract(text, '^\s*(`{3,}|~{3,})', 1) AS f FROM lf),
sf AS (SELECT doc_id, 0::BIGINT AS line, '' AS fence, true AS skip, '' AS text FROM fenced UNION ALL SELECT ff.doc_id, ff.line, CASE WHEN sf.fence = '' THEN f WHEN f <> '' AND f[1] = sf.fence[1] AND length(f) >= length(sf.fence) THEN '' ELSE sf.fence END, sf.fence <> '' OR f <> '', ff.text FROM sf JOIN ff ON ff.doc_id = sf.doc_id AND ff.line = sf.line + 1)
SELECT doc_id AS node_id, line::INT AS line, text FROM (SELECT doc_id, line, trim(unnest(regexp_extract_all(text, '``(.*?)``', 1))) AS text FROM sf WHERE NOT skip UNION ALL SELECT doc_id, line, trim(unnest(regexp_extract_all(regexp_replace(text, '``.*?``', '', 'g'), '`([^`]+)`', 1))) FROM sf WHERE NOT skip)""", True)
def fenced_spans(t):
    return X.code_spans(t.fenced.select(F.col("doc_id").alias("node_id"), "content"))


@query(r"""SELECT doc_id::VARCHAR AS node_id, 'Part ' || doc_id || ' of it' AS name, len(regexp_extract_all(content, '(?m)^\s*[-*]\s')) AS bullets, regexp_matches(content, '(?im)^\s*(?:[-*]\s*)?tab:\s*true') AS tab FROM fenced""")
def features(t):
    return X.feature_entries(t.fenced.select(F.col("doc_id").cast("string").alias("node_id"), "content"))


@query(r"""tl AS (SELECT node_id, unnest(string_split(content, chr(10))) AS text FROM classdocs), tc AS (SELECT node_id, regexp_extract(text, '^---@class ([A-Za-z0-9_.]+)', 1) AS src, regexp_extract(text, ': (.*)$', 1) AS up FROM tl WHERE starts_with(text, '---@class')),
te AS (SELECT node_id, src, unnest(string_split(up, ', ')) AS dst, 'extends' AS kind FROM tc UNION SELECT tl.node_id, src, unnest(regexp_extract_all(regexp_extract(text, '^---@field [a-z]+ ([^ ]+)', 1), '[A-Za-z_][A-Za-z0-9_.]*')), 'type' FROM tl JOIN tc ON tl.node_id = tc.node_id WHERE starts_with(text, '---@field'))
SELECT * FROM te WHERE src <> dst AND (kind = 'extends' OR regexp_matches(dst, '^[A-Z]|[.]'))""")
def type_references(t):
    return X.type_edges(X.doc_tags(t.classdocs))


@query(r"""tk AS (SELECT DISTINCT 'C' || (k % 7) AS dst, 'C' || k AS src FROM classdocs), w AS (SELECT 'C1' AS node, 0 AS d UNION SELECT src, d + 1 FROM w JOIN tk ON dst = node AND src <> dst WHERE d < 3) SELECT node, min(d) AS d FROM w GROUP BY node""", True)
def type_walk(t):
    """Types that extend C1, directly or not, within 3 steps."""
    ups = X.type_edges(X.doc_tags(t.classdocs)).where("kind = 'extends'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.walk(ups, t.spark.createDataFrame([("C1",)], "node string"), 3)


@query(r"""pl AS (SELECT node_id, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS text FROM specfiles)
SELECT node_id, line::INT AS line, regexp_extract(text, '"(own/[a-z0-9]+)"', 1) AS repo, regexp_extract(text, 'lazy = (true|false)', 1) AS lazy, replace(replace(regexp_extract(text, 'event = . ([^}]*) .', 1), '"', ''), ', ', ',') AS triggers FROM pl WHERE contains(text, 'own/')
UNION ALL SELECT node_id, line::INT, regexp_extract(text, '"(dep/[a-z0-9]+)"', 1), '-', '' FROM pl WHERE contains(text, 'dep/')
UNION ALL SELECT node_id, line::INT, regexp_extract(text, '/(x/[a-z0-9]+)"', 1), '-', regexp_extract(text, 'cmd = "([^"]*)"', 1) || ',' || array_to_string(regexp_extract_all(text, '. "([^"]*)"(?:, "x")? .[,} ]', 1)[-2:], ',') FROM pl WHERE contains(text, 'src =')""")
def plugin_tables(t):
    return X.plugin_specs(t.specfiles).select("node_id", "line", "repo", F.coalesce(F.col("lazy").cast("string"), F.lit("-")).alias("lazy"), F.array_join("triggers", ",").alias("triggers"))


LADDER = r"""cc AS (SELECT src, from_key, to_key, to_fn, dst, f.k % 6 AS v, regexp_extract(to_fn, '([A-Za-z0-9_]+)$', 1) AS bare FROM calls JOIN fns f ON f.fn_key = to_key),
raw AS (SELECT src AS node_id, from_key, v, bare, dst, to_key, CASE v WHEN 0 THEN 'require("' || (SELECT min(module) FROM modules m WHERE m.node_id = dst) || '").' || bare WHEN 1 THEN 'm.' || bare WHEN 2 THEN 'ext.' || bare WHEN 3 THEN 'imp_' || bare WHEN 4 THEN to_fn ELSE bare END AS callee FROM cc),
bx AS (SELECT node_id, regexp_extract(fn_name, '([A-Za-z0-9_]+)$', 1) AS name, fn_key, fn_name, k FROM fns), uq AS (SELECT name, min(fn_key) AS fn_key FROM bx GROUP BY name HAVING count(*) = 1), al AS (SELECT src AS node_id, min(dst) AS target FROM calls GROUP BY src),
sb AS (SELECT parent_id, bx.name, min(bx.node_id) AS node_id, arg_max(fn_key, k) AS fn_key FROM bx JOIN nodes n ON bx.node_id = n.node_id WHERE n.language = 'ts' OR n.language = 'typescript' GROUP BY 1, 2 HAVING count(DISTINCT bx.node_id) = 1),
px AS (SELECT DISTINCT node_id, split_part(fn_name, '.', 1) AS head FROM fns WHERE contains(fn_name, '.')),
rg AS (SELECT raw.*, CASE WHEN v = 0 THEN CASE WHEN regexp_matches(callee, '^require\("[\w.-]+"\)') THEN 'inline' END WHEN v = 1 AND al.target IS NOT NULL THEN 'alias' WHEN v = 2 THEN 'external' WHEN v = 4 AND contains(callee, '.') THEN CASE WHEN px.head IS NOT NULL AND regexp_matches(callee, '^\w+\.[\w.]+$') THEN 'own' END WHEN v <> 3 AND o.fn_key IS NOT NULL THEN 'own' WHEN v <> 3 AND s.fn_key IS NOT NULL THEN 'sibling' WHEN v = 3 THEN 'import' WHEN u.fn_key IS NOT NULL THEN 'unique' END AS rung, al.target, o.fn_key AS own_key, s.fn_key AS sib_key, u.fn_key AS uq_key
FROM raw LEFT JOIN al ON raw.node_id = al.node_id LEFT JOIN px ON raw.node_id = px.node_id AND px.head = split_part(callee, '.', 1) LEFT JOIN bx o ON o.node_id = raw.node_id AND o.name = callee LEFT JOIN nodes n ON n.node_id = raw.node_id AND n.language = 'typescript' LEFT JOIN sb s ON s.parent_id = n.parent_id AND s.name = callee LEFT JOIN uq u ON u.name = callee),
re AS (SELECT rg.node_id, from_key AS from_fn, callee, rung, CASE rung WHEN 'inline' THEN i.fn_key WHEN 'import' THEN i.fn_key WHEN 'alias' THEN a.fn_key WHEN 'own' THEN coalesce(w.fn_key, x.fn_key, own_key) WHEN 'sibling' THEN sib_key WHEN 'unique' THEN uq_key END AS to_key FROM rg LEFT JOIN bx i ON i.node_id = dst AND i.name = bare LEFT JOIN bx a ON a.node_id = target AND a.name = bare LEFT JOIN bx w ON w.node_id = rg.node_id AND w.fn_name = callee LEFT JOIN bx x ON x.node_id = rg.node_id AND x.name = bare AND contains(callee, '.'))"""


def _ladder(t):
    """Calls written in the six ways that the ladder tells apart, by the key of what is called."""
    of = t.kept("fns").select(F.col("fn_key").alias("to_key"), (F.col("k") % 6).alias("v"))
    mods = t.kept("modules").select(F.col("node_id").alias("dst"), F.col("module").alias("to_module"))
    c = t.kept("calls").join(of, "to_key").join(mods, "dst").withColumn("bare", S.bare_name(F.col("to_fn")))
    text = F.when(F.col("v") == 0, F.concat(F.lit('require("'), "to_module", F.lit('").'), "bare")).when(F.col("v") == 1, F.concat(F.lit("m."), "bare")).when(F.col("v") == 2, F.concat(F.lit("ext."), "bare")).when(F.col("v") == 3, F.concat(F.lit("imp_"), "bare")).when(F.col("v") == 4, F.col("to_fn")).otherwise(F.col("bare"))
    raw = c.select(F.col("src").alias("node_id"), F.xxhash64("from_key", "to_key").alias("seq"), text.alias("callee"), F.col("from_key").alias("from_fn"), F.lit(1).alias("line"))
    aliases = t.kept("calls").groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("target")).select("node_id", F.lit("m").alias("alias"), "target", F.lit("?").alias("module"))
    aliases = aliases.union(aliases.select("node_id", F.lit("ext"), F.lit(None).cast("string"), F.lit("ext.lib")))
    imports = c.where("v = 3").select(F.col("src").alias("node_id"), F.concat(F.lit("imp_"), "bare").alias("name"), F.col("dst").alias("target"), F.lit("?").alias("module"), F.col("bare").alias("member")).distinct()
    near = R.package_siblings(t.kept("fns"), t.nodes, ("typescript",)).withColumnRenamed("node_id", "of").join(t.nodes.where("language = 'typescript'").select("node_id", "parent_id"), "parent_id").select("node_id", "name", "fn_key")
    return R.resolve_calls(raw, t.kept("fns"), aliases, True, t.kept("modules").select("module", "node_id"), near, imports)


@query(LADDER + " SELECT DISTINCT node_id, from_fn, callee, rung, to_key FROM re WHERE rung IS NOT NULL AND (to_key IS NULL OR to_key <> from_fn)")
def call_ladder(t):
    return _ladder(t).where("rung is not null").select("node_id", "from_fn", "callee", "rung", "to_key").distinct()


@query(LADDER + " SELECT node_id, 'ext.lib' AS module, substr(callee, 5) AS member, count(*) AS n FROM re WHERE rung = 'external' GROUP BY ALL")
def external_call_counts(t):
    return R.external_calls(_ladder(t)).toDF("node_id", "module", "member", "n")


@query(SPANS.replace("FROM fns)", "FROM fns WHERE k % 10 < 8)") + ", " + SPANS.replace("sp AS", "sq AS").replace("FROM fns)", "FROM fns WHERE k % 10 > 1)") + """,
hb AS (SELECT DISTINCT sha, h.node_id, fn_key, '-' AS side FROM hunks h JOIN sp ON h.node_id = sp.node_id WHERE sha % 3 < 2 AND NOT (h.last < sp.line OR h.first > coalesce(sp.last, 1000000000)) UNION SELECT DISTINCT sha, h.node_id, fn_key, '+' FROM hunks h JOIN sq ON h.node_id = sq.node_id WHERE sha % 3 > 0 AND NOT (h.last < sq.line OR h.first > coalesce(sq.last, 1000000000)))
SELECT sha, node_id, fn_key, string_agg(side, '' ORDER BY side) AS sides FROM hb GROUP BY 1, 2, 3""")
def two_sided_hits(t):
    hunks = t.hunks.where("sha % 3 < 2").withColumn("side", F.lit("-")).unionByName(t.hunks.where("sha % 3 > 0").withColumn("side", F.lit("+")))
    return R.two_sided(hunks, t.fns.where("k % 10 < 8"), t.fns.where("k % 10 > 1"))


@query(r"""ex AS (SELECT text, arg_min(kind, entity) AS kind, min(entity) AS entity FROM (SELECT module AS text, node_id AS entity, 'module' AS kind FROM modules UNION ALL SELECT fn_name, fn_key, 'function' FROM fns WHERE contains(fn_name, '.')) GROUP BY text),
nz AS (SELECT DISTINCT array_to_string(string_split(module, '.')[1:i], '.') AS text FROM modules, range(1, 5) r(i)) SELECT text, entity, kind FROM ex UNION ALL SELECT text, text, 'namespace' FROM nz WHERE text NOT IN (SELECT text FROM ex)""")
def entity_keys(t):
    return R.entity_index(t.nodes, t.fns)


# aggregates, panels, routes


@query(FINDINGS + """ SELECT "check", node_id, rank::INT AS rank, total FROM (SELECT "check", node_id, row_number() OVER (PARTITION BY "check" ORDER BY node_id) AS rank, count(*) OVER (PARTITION BY "check") AS total FROM ff) WHERE rank <= 20""")
def bounded_evidence(t):
    return A.evidence(_findings(t), "check", "node_id")


@query(r"""pf AS (SELECT fn_key, fn_name FROM fns WHERE NOT internal), ww AS (SELECT DISTINCT unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM markdown),
vv AS (SELECT 'examples' AS probe, floor(1000 * count(*) FILTER (WHERE fn_key IN (SELECT node_id FROM luafiles WHERE contains(content, '---@example'))) / count(*) + 0.5) / 10 AS "value" FROM pf UNION ALL SELECT 'docs_mentions', floor(1000 * count(*) FILTER (WHERE regexp_extract(fn_name, '([A-Za-z0-9_]+)$', 1) IN (SELECT word FROM ww)) / count(*) + 0.5) / 10 FROM pf
UNION ALL SELECT 'deprecated', sum(len(regexp_extract_all(content, '---@deprecated'))) FROM luafiles UNION ALL SELECT 'todos', sum(len(regexp_extract_all(content, '---@todo'))) FROM luafiles UNION ALL SELECT 'recorded_defects', sum(len(regexp_extract_all(content, '---@bug'))) FROM luafiles) SELECT probe, "value"::DOUBLE AS "value" FROM vv""")
def tag_probe_values(t):
    return A.tag_probes(t.fns, X.doc_tags(t.luafiles), t.markdown.select(F.col("content").alias("text")))


@query(FINDINGS + """ SELECT 0 AS part, '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"sparkloom","rules":[' AS text UNION ALL SELECT 1, CASE WHEN row_number() OVER (ORDER BY "check") > 1 THEN ',' ELSE '' END || '{"id":"' || "check" || '","name":"' || "check" || '","shortDescription":{"text":"' || "check" || '"}}' FROM (SELECT DISTINCT "check" FROM ff)
UNION ALL SELECT 2, ']}},"invocations":[{"executionSuccessful":true}],"results":[' UNION ALL SELECT 3, '{"ruleId":"' || "check" || '","level":"' || CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || message || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || node_id || '"},"region":{"startLine":1}}}]}' FROM ff UNION ALL SELECT 4, ']}]}'""")
def results_log(t):
    log = K.exchange_log(_findings(t))
    return log.select("part", F.when(F.col("part") == 3, F.regexp_replace("text", "^,", "")).otherwise(F.col("text")).alias("text"))


SQL["sarif"] = SQL["results_log"].replace("SELECT 0 AS part", "SELECT text AS result FROM (SELECT 0 AS part") + ") WHERE part = 3"


@query("""SELECT path FROM (SELECT CASE k % 5 WHEN 0 THEN 'docs/map/' WHEN 1 THEN '.git/' WHEN 2 THEN 'a/node_modules/' ELSE 'docs/' END || replace(path, '.lua', '.md') AS path FROM modules) WHERE path LIKE 'docs/%.md' AND NOT path LIKE 'docs/map/%'""")
def corpus_files(t):
    place = F.when(F.col("k") % 5 == 0, "docs/map/").when(F.col("k") % 5 == 1, ".git/").when(F.col("k") % 5 == 2, "a/node_modules/").otherwise("docs/")
    return X.corpus(t.modules.select(F.concat(place, F.replace("path", F.lit(".lua"), F.lit(".md"))).alias("path")))


@query("""SELECT regexp_extract(path, '[.]([a-z]+)$', 1) AS ext, least(count(*), 20000) AS n FROM modules WHERE NOT starts_with(path, 'asia/') AND NOT starts_with(path, 'europe/') GROUP BY 1""")
def outside_counts(t):
    return X.outside(t.modules.select("path"), ["asia", "europe/"])


@query("""SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS types FROM modules WHERE k % 5 = 0 GROUP BY 1""")
def types_folders(t):
    moved = F.when(F.col("k") % 5 == 0, F.regexp_replace("path", "/([^/]*)$", "/@types/$1")).otherwise(F.col("path"))
    return X.types_folded(t.modules.select(moved.alias("path")))[1]


@query("""SELECT '.' AS node_id, NULL AS parent_id, 0 AS depth UNION ALL SELECT 'a:' || node_id, coalesce('a:' || parent_id, '.'), depth + 1 FROM nodes UNION ALL SELECT 'b:' || node_id, coalesce('b:' || parent_id, '.'), depth + 1 FROM nodes WHERE depth < 3""")
def multi_root_nodes(t):
    n = t.nodes.select("node_id", "parent_id", "depth")
    return X.multi_root({"a": n, "b": n.where("depth < 3")})


@query("""w AS (SELECT '.' AS node, 0 AS d UNION ALL SELECT node_id, d + 1 FROM w JOIN nodes ON parent_id = node) SELECT node, d FROM w JOIN nodes ON node_id = node ORDER BY d, ord, node LIMIT 60""", True)
def tree_walk_first(t):
    return G.tree_walk(t.nodes, t.spark.createDataFrame([(".",)], "node string"), 60)


@query("""SELECT 'new' AS project, language, count(*) AS n FROM modules WHERE k % 2 = 1 GROUP BY 2 UNION ALL SELECT 'old', language, count(*) FROM modules WHERE k % 2 = 0 GROUP BY 2""")
def project_languages(t):
    both = S_FILES.by_project({"old": t.modules.where("k % 2 = 0"), "new": t.modules.where("k % 2 = 1")})
    return both.groupBy("project", "language").agg(F.count(F.lit(1)).alias("n"))


@query("""l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS text FROM markdown), s AS (SELECT doc_id, unnest(regexp_extract_all(text, '`([^`]+)`', 1)) AS text FROM l), ex AS (SELECT module AS text FROM modules UNION SELECT fn_name FROM fns WHERE fn_name LIKE '%.%'),
u AS (SELECT regexp_extract(fn_name, '([A-Za-z0-9_]+)$', 1) AS text FROM fns GROUP BY 1 HAVING count(*) = 1)
SELECT doc_id, count(*) AS refs, count(*) FILTER (WHERE text LIKE '%.%') AS exact FROM s WHERE CASE WHEN text LIKE '%.%' THEN text IN (SELECT text FROM ex) ELSE text IN (SELECT text FROM u) END GROUP BY doc_id""")
def docs_panel(t):
    refs = FOUND["doc_references"](t.spark, t.sf_dir)
    return refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("confidence") == "exact").alias("exact"))


@query("""SELECT src AS node_id, 'module' AS kind, dst AS label FROM edges UNION SELECT node_id, 'external', module FROM requires_raw WHERE starts_with(module, 'ext.')""")
def dependency_entries(t):
    ours = t.edges.select(F.col("src").alias("node_id"), F.lit("module").alias("kind"), F.col("dst").alias("label"))
    ext = R.external_requires(R.resolve_requires(t.requires_raw, t.nodes), t.nodes)
    return ours.unionByName(ext.select("node_id", F.lit("external").alias("kind"), F.col("module").alias("label"))).distinct()


@query("SELECT sha, day::VARCHAR AS day, count(DISTINCT path) AS files FROM commits GROUP BY sha, day ORDER BY commits.day DESC, sha DESC LIMIT 7")
def route_commits(t):
    return registry.answer(t.spark, t.sf_dir, "commits", "7").withColumn("day", F.col("day").cast("string"))


@query("SELECT path, node_id, sha, first, last FROM hunks WHERE sha = 7")
def route_commit(t):
    return registry.answer(t.spark, t.sf_dir, "commit/7").select("path", "node_id", "sha", "first", "last")


@query("""SELECT 'error' AS severity, 'missing-module-tag' AS "check", node_id, '-' AS detail FROM modules WHERE language = 'lua' AND k % 4 = 0""")
def missing_module_tags(t):
    untold = t.modules.withColumn("module", F.when(F.col("k") % 4 > 0, F.col("module")))
    return C.missing_module_tag(untold, ["lua"]).withColumn("detail", F.lit("-"))


@query(r"""SELECT node_id, CASE WHEN contains(content, 'return setmetatable') THEN 'call' ELSE 'name' END AS export FROM luafiles""")
def export_kinds(t):
    return X.export_shapes(t.luafiles).toDF("node_id", "export")


@query(r"""SELECT node_id, word, count(*) AS n FROM (SELECT node_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM codefiles) GROUP BY 1, 2""")
def identifier_counts(t):
    return X.identifiers(t.codefiles)


@query(FINDINGS + """ SELECT severity, "check", node_id, detail FROM ff WHERE severity = 'warn' AND "check" = 'missing-summary'""")
def findings_filtered(t):
    return Q.findings_where(_findings(t), "warn", "missing-summary").select("severity", "check", "node_id", "detail")


@query("""SELECT module FROM modules WHERE node_id NOT IN (SELECT node_id FROM modules WHERE k % 3 = 0)""")
def not_hidden(t):
    return Q.without(t.modules, t.modules.where("k % 3 = 0").select("node_id"), "node_id").select("module")


@query(f"""ea AS (SELECT DISTINCT src, dst FROM links WHERE {BEFORE}), ra AS (SELECT src, dst FROM ea UNION SELECT r.src, e.dst FROM ra r JOIN ea e ON r.dst = e.src), ca AS (SELECT a.src AS node, string_agg(a.dst, ',' ORDER BY a.dst) AS members FROM ra a JOIN ra b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) > 1),
eb AS (SELECT DISTINCT src, dst FROM links WHERE {AFTER}), rb AS (SELECT src, dst FROM eb UNION SELECT r.src, e.dst FROM rb r JOIN eb e ON r.dst = e.src), cb AS (SELECT a.src AS node, string_agg(a.dst, ',' ORDER BY a.dst) AS members FROM rb a JOIN rb b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) > 1)
SELECT DISTINCT members, 'removed' AS change FROM ca WHERE members NOT IN (SELECT members FROM cb) UNION SELECT DISTINCT members, 'added' FROM cb WHERE members NOT IN (SELECT members FROM ca)""", True)
def changed_cycles(t):
    """Cycles that one of the two snapshots has."""
    links = t.kept("links")
    return D.cycle_changes(*[G.cycles(links.where(w).select("src", "dst").distinct()) for w in (BEFORE, AFTER)])


@query("""SELECT fn_key, array_to_string(string_split(content, chr(10))[line:line + least(n, 40) - 1], chr(10)) AS snippet, greatest(n - 40, 0)::INT AS omitted FROM (SELECT node_id AS fn_key, content, 11 AS line, CASE WHEN k % 3 = 0 THEN 60 ELSE 4 END AS n FROM luafiles)""")
def function_snippets(t):
    at = t.luafiles.select("node_id", F.col("node_id").alias("fn_key"), F.lit(11).alias("first"), F.when(F.col("k") % 3 == 0, 70).otherwise(14).alias("last"))
    return X.snippets(at, t.luafiles.select("node_id", "content")).select("fn_key", "snippet", "omitted")


@query("""SELECT url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM (SELECT DISTINCT url FROM requests)""")
def decoded_paths(t):
    return t.requests.select("url").distinct().select("url", S.percent_decoded(S.route_path(F.col("url"))).alias("path"))


@query("SELECT shape, left(sha256(shape), 16) AS hash FROM (SELECT DISTINCT shape FROM fns)")
def shape_hashes(t):
    return t.fns.select("shape").distinct().select("shape", S.shape_hash(F.col("shape")).alias("hash"))
