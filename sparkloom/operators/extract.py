"""Extractors by SQL built-ins over files (node_id, content): lines, requires, markers, code spans, diffs, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.intervals import inside

#: Marker kinds and their spellings, longest first where one begins another.
MARKERS = {
    "TODO": ["TODO"], "FIX": ["FIXME", "FIXIT", "FIX", "BUG", "ISSUE"], "HACK": ["HACK"], "WARN": ["WARNING", "WARN", "XXX"],
    "PERF": ["PERFORMANCE", "OPTIMIZE", "OPTIM", "PERF"], "NOTE": ["NOTE", "INFO"], "TEST": ["TESTING", "TEST", "PASSED", "FAILED"],
}
#: HTTP verbs of endpoint calls, the most lines of a header and of a snippet, folders of vendors.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "all")
HEADER_LINES, SNIPPET_LINES = 200, 40
VENDORS = ("node_modules", "vendor", "target", "dist", "build", "__pycache__")


def lines(files: DataFrame, keep: tuple[str, ...] = ("node_id",), text: str = "content") -> DataFrame:
    """(keep, line from 1, text) of each line."""
    return files.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("p", "text")).select(*keep, (F.col("p") + 1).alias("line"), "text")


def line_counts(files: DataFrame) -> DataFrame:
    """(node_id, lines): a last line break ends a line and begins none."""
    n = F.size(F.split("content", "\n", -1))
    return files.select("node_id", F.when(F.col("content") == "", 0).when(F.endswith("content", F.lit("\n")), n - 1).otherwise(n).alias("lines"))


def lua_requires(files: DataFrame) -> DataFrame:
    """(node_id, line, module, alias): require calls outside comment lines; empty segments are rejected."""
    code = lines(files).where(~F.col("text").rlike(r"^\s*--"))
    call = r"require\s*\(?\s*[\"']([^\"']+)[\"']"
    found = code.select("node_id", "line", F.explode(F.regexp_extract_all("text", F.lit(call), F.lit(1))).alias("module"), "text")
    alias = F.regexp_extract("text", r"^\s*local\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*require", 1)
    return found.where(~F.col("module").rlike(r"(^\.(?!\.?/))|\.\.(?!/)|\.$")).select("node_id", "line", "module", F.when(alias != "", alias).alias("alias"))


def deferred(requires: DataFrame, spans: DataFrame) -> DataFrame:
    """requires with deferred: whether the line lies within a function's lines (node_id, first, last)."""
    held = inside(requires.select("node_id", "line").distinct(), "line", spans.select("node_id", "first", "last"), "first", "last", ["node_id"])
    held = held.select("node_id", "line").distinct().withColumn("deferred", F.lit(True))
    return requires.join(held, ["node_id", "line"], "left").withColumn("deferred", F.coalesce("deferred", F.lit(False)))


def markers(files: DataFrame) -> DataFrame:
    """(node_id, line, kind, word, author, text): the first marker of each line, spans in backticks masked."""
    words = [w for ws in MARKERS.values() for w in ws]
    pattern = r"(?<![A-Za-z0-9_])(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")\s*(?:\(([^)]*)\))?\s*:\s*(.*)$"
    masked = F.regexp_replace("text", "`[^`]*`", " ")
    got = lines(files).withColumn("m", masked).withColumn("word", F.regexp_extract("m", pattern, 1)).where("word != ''")
    kinds = F.create_map(*[F.lit(x) for k, ws in MARKERS.items() for w in ws for x in (w, k)])
    author = F.regexp_extract("m", pattern, 2)
    return got.select("node_id", "line", kinds[F.col("word")].alias("kind"), "word", F.when(author != "", author).alias("author"), F.trim(F.regexp_extract("m", pattern, 3)).alias("text"))


#: By family of languages: comments (block, then line), then strings: alternatives of one expression.
QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
LEXES = {
    "lua": (r"--\[(?<a>=*)\[[\s\S]*?\]\k<a>\]|--[^\n]*+", r"\[(?<b>=*)\[[\s\S]*?\]\k<b>\]|" + QUOTED),
    "braces": (r"/\*[\s\S]*?\*/|//[^\n]*+", QUOTED + r"|`[^`]*+`"),
    "hash": (r"#[^\n]*+", r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + QUOTED),
}


def tokens(files: DataFrame, family: str = "lua", keep: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """(keep, pos, line, kind, text) of files (keep, content): comments, strings and words in their order, by one expression.

    The alternatives take a text from left to right, so what stands in a string is no comment and the other way round. What is
    between tokens is matched too, and a token's line is the newlines of all before it: a running sum over the
    file's tokens. A string that is not closed is no token; a block comment that is not closed ends with its line.
    """
    comment, string = LEXES[family]
    parts = F.regexp_extract_all("content", F.lit(rf"(?:{comment})|(?:{string})|[A-Za-z_][A-Za-z0-9_]*+|[\s\S]"), F.lit(0))
    rows = files.select(*keep, F.posexplode(parts).alias("pos", "text"))
    before = Window.partitionBy(*keep).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("text") - F.length(F.translate("text", "\n", ""))
    real = rows.where(F.col("text").rlike(r"^[A-Za-z_]|[\s\S]{2}|\n")).withColumn("line", (F.coalesce(F.sum(breaks).over(before), F.lit(0)) + 1).cast("int"))
    kind = F.when(F.col("text").rlike(f"^(?:{comment})$"), "comment").when(F.col("text").rlike("^[A-Za-z_]"), "word").otherwise("string")
    return real.where("text != '\\n'").select(*keep, "pos", "line", kind.alias("kind"), "text")


def comment_markers(found: DataFrame, keep: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """(keep, line, nth, kind, word, author, text) of tokens: all markers of each line of a comment, each with the text up to the next."""
    words = sorted((w for ws in MARKERS.values() for w in ws), key=lambda w: (-len(w), w))
    mark = rf"(?<![A-Za-z0-9_])({'|'.join(words)})\s*(?:\(([^)]*)\))?\s*:"
    bare = F.regexp_replace("text", r"^--\[=*\[|\]=*\]$|\*/$|^(?:--+|//+|/\*+|#+)", "")
    rows = found.where("kind = 'comment'").select(*keep, "line", F.posexplode(F.split(bare, "\n", -1)).alias("below", "said"))
    pieces = F.slice(F.split(F.regexp_replace("said", mark, "\x01$1\x02$2\x02"), "\x01", -1), 2, 1 << 30)
    each = rows.select(*keep, (F.col("line") + F.col("below")).alias("line"), F.posexplode(pieces).alias("nth", "piece")).withColumn("p", F.split("piece", "\x02", 3))
    kinds = F.create_map(*[F.lit(x) for k, ws in MARKERS.items() for w in ws for x in (w, k)])
    author = F.col("p")[1]
    return each.select(*keep, "line", "nth", kinds[F.col("p")[0]].alias("kind"), F.col("p")[0].alias("word"), F.when(author != "", author).alias("author"), F.trim(F.col("p")[2]).alias("text"))


def local_refs(fns: DataFrame, found: DataFrame) -> DataFrame:
    """fns (node_id, fn_key, fn_name) with local_refs: how often a function's bare name stands in its file, in code, beyond its declarations."""
    from sparkloom.functions.scalar import bare_name

    named = fns.select("node_id", "fn_key", bare_name(F.col("fn_name")).alias("text"))
    declared = named.groupBy("node_id", "text").agg(F.count(F.lit(1)).alias("own"))
    seen = found.where("kind = 'word'").groupBy("node_id", "text").agg(F.count(F.lit(1)).alias("n"))
    refs = F.greatest(F.coalesce("n", F.lit(0)) - F.col("own"), F.lit(0))
    return named.join(declared, ["node_id", "text"]).join(seen, ["node_id", "text"], "left").select("node_id", "fn_key", refs.alias("local_refs"))


def code_spans(files: DataFrame) -> DataFrame:
    """(node_id, line, text): spans in backticks outside fenced blocks, trimmed; those in double backticks come first and may hold single ones."""
    rows = files.select("node_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    mark = F.regexp_extract("text", r"^[ \t\r\x0b\f]*(`{3,}|~{3,})", 1)
    marked = rows.withColumn("fence", mark)
    # a file's fences are few: which of them open and close is worked out over their list, and lines find their block by range
    fences = marked.where("fence != ''").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("at", "fence"))).alias("f"))
    begin = F.struct(F.lit("").alias("open"), F.lit(-1).alias("since"), F.array().cast("array<struct<first:int,last:int>>").alias("blocks"))

    def step(a, x):
        same = (F.substring(a["open"], 1, 1) == F.substring(x["fence"], 1, 1)) & (F.length(x["fence"]) >= F.length(a["open"]))
        closed = F.struct(F.lit("").alias("open"), F.lit(-1).alias("since"), F.concat(a["blocks"], F.array(F.struct(a["since"].alias("first"), x["at"].alias("last")))).alias("blocks"))
        return F.when(a["open"] == "", F.struct(x["fence"].alias("open"), x["at"].alias("since"), a["blocks"].alias("blocks"))).when(same, closed).otherwise(a)

    last = lambda a: F.when(a["open"] == "", a["blocks"]).otherwise(F.concat(a["blocks"], F.array(F.struct(a["since"].alias("first"), F.lit(2147483647).alias("last")))))
    blocks = fences.select("node_id", F.aggregate("f", begin, step, last).alias("blocks"))
    ticked = rows.where(F.col("text").contains("`")).join(blocks, "node_id", "left")
    outside = ticked.where(~F.coalesce(F.exists("blocks", lambda b: F.col("at").between(b["first"], b["last"])), F.lit(False)))
    double, single = F.regexp_extract_all("text", F.lit("``(.*?)``"), F.lit(1)), F.regexp_extract_all(F.regexp_replace("text", "``.*?``", ""), F.lit("`([^`]+)`"), F.lit(1))
    spans = outside.select("node_id", (F.col("at") + 1).alias("line"), F.explode(F.concat(double, single)).alias("text"))
    return spans.select("node_id", "line", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text != ''")


def markdown_links(files: DataFrame, keep: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """(keep, target) of links, code spans masked."""
    return files.select(*keep, F.explode(F.regexp_extract_all(F.regexp_replace("content", "`[^`]*`", " "), F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))).alias("target"))


def headers(files: DataFrame, comment: str = r"--") -> DataFrame:
    """(node_id, header): the comment lines before the first other line, within HEADER_LINES."""
    first = lines(files).where(F.col("line") <= HEADER_LINES).withColumn("c", F.col("text").rlike(rf"^\s*({comment}|$)"))
    end = first.where("not c").groupBy("node_id").agg(F.min("line").alias("end"))
    held = first.join(end, "node_id", "left").where("end is null or line < end")
    return held.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("header"))


def export_shapes(files: DataFrame) -> DataFrame:
    """(node_id, export): what the last return at the margin gives: table, function, call, name or none."""
    last = F.try_element_at(F.regexp_extract_all("content", F.lit(r"(?m)^return\s+(.*)$"), F.lit(1)), F.lit(-1))
    t = F.trim(last)
    return files.select("node_id", F.when(last.isNull(), "none").when(t.startswith("{"), "table").when(t.startswith("function"), "function").when(t.contains("("), "call").otherwise("name").alias("export"))


def endpoints(files: DataFrame) -> DataFrame:
    """(node_id, line, method, route, handler): calls x.verb("/path", ..., handler)."""
    pattern = r"\.(" + "|".join(VERBS) + r")\s*\(\s*[\"'](/[^\"']*)[\"'](?:.*,\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\))?"
    got = lines(files).withColumn("method", F.regexp_extract("text", pattern, 1)).where("method != ''")
    handler = F.regexp_extract("text", pattern, 3)
    return got.select("node_id", "line", "method", F.regexp_extract("text", pattern, 2).alias("route"), F.when(handler != "", handler).alias("handler"))


def snippets(fns: DataFrame, files: DataFrame) -> DataFrame:
    """fns (node_id, fn_key, first, last) with snippet, up to SNIPPET_LINES lines, and how many are left out."""
    both = fns.join(files, "node_id").withColumn("all", F.split("content", "\n", -1)).withColumn("n", F.col("last") - F.col("first") + 1)
    return both.select("node_id", "fn_key", F.array_join(F.slice("all", F.col("first"), F.least("n", F.lit(SNIPPET_LINES))), "\n").alias("snippet"), F.greatest(F.col("n") - SNIPPET_LINES, F.lit(0)).alias("omitted"))


def identifiers(files: DataFrame) -> DataFrame:
    """(node_id, word, n)."""
    return files.select("node_id", F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("word")).groupBy("node_id", "word").agg(F.count(F.lit(1)).alias("n"))


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(sha, path, side, first, last) of unified diffs (sha, content): ranges of no lines and /dev/null are dropped."""
    w = Window.partitionBy("sha").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    path = lambda sign: F.when(F.col("text").startswith(sign * 3 + " "), F.regexp_replace(F.substr("text", F.lit(5)), r"^[ab]/|\t.*$", ""))
    rows = lines(diffs, ("sha",)).withColumn("old", F.last(path("-"), True).over(w)).withColumn("new", F.last(path("+"), True).over(w)).where(F.col("text").startswith("@@"))
    num = lambda i: F.regexp_extract("text", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    side = lambda name, p, a, n: F.struct(F.lit(name).alias("side"), F.col(p).alias("path"), num(a).cast("long").alias("first"), F.when(num(n) == "", 1).otherwise(num(n).cast("long")).alias("n"))
    each = rows.where(num(1) != "").select("sha", F.explode(F.array(side("-", "old", 1, 2), side("+", "new", 3, 4))).alias("x")).select("sha", "x.*")
    return each.where("n > 0 and path != '/dev/null'").select("sha", "path", "side", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def log_commits(text: DataFrame) -> DataFrame:
    """(sha, day, path) of a log whose records begin with the byte 1e and have `sha 1f day` before their paths."""
    record = text.select(F.explode(F.split("content", "\x1e")).alias("r")).where("trim(r) != ''")
    parts = F.split("r", "\n")
    head = F.split(parts[0], "\x1f")
    return record.select(head[0].alias("sha"), F.try_to_date(F.get(head, F.lit(1))).alias("day"), F.explode(F.array_distinct(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p != ""))).alias("path"))


def checklist_items(files: DataFrame) -> DataFrame:
    """(node_id, line, section, done, text, ref, ref_line, verified) of `- [x]` items; the section is the heading last seen."""
    w = Window.partitionBy("node_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.regexp_extract("text", r"^#+\s+(.*)$", 1)
    rows = lines(files).withColumn("section", F.last(F.when(heading != "", heading), True).over(w)).withColumn("mark", F.regexp_extract("text", r"^\s*[-*]\s+\[([ xX])\]", 1)).where("mark != ''")
    part = lambda p, i: F.when(F.regexp_extract("text", p, i) != "", F.regexp_extract("text", p, i))
    body = F.trim(F.regexp_replace(F.regexp_replace("text", r"^\s*[-*]\s+\[[ xX]\]\s*", ""), r"<!--.*?-->|@(ref|verified)\s+\S+", ""))
    return rows.select("node_id", "line", "section", (F.lower("mark") == "x").alias("done"), body.alias("text"), part(r"@ref\s+([^\s:>]+)", 1).alias("ref"), part(r"@ref\s+[^\s:>]+:(\d+)", 1).try_cast("int").alias("ref_line"), F.try_to_date(part(r"@verified\s+(\d{4}-\d{2}-\d{2})", 1)).alias("verified"))


def feature_entries(files: DataFrame) -> DataFrame:
    """(node_id, name, bullets, tab): second-level headings with their bullets; `Tab: true` promotes."""
    w = Window.partitionBy("node_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    h = F.regexp_extract("text", r"^##\s+(.*)$", 1)
    rows = lines(files).withColumn("name", F.last(F.when(h != "", h), True).over(w)).where("name is not null")
    return rows.groupBy("node_id", "name").agg(F.sum(F.col("text").rlike(r"^\s*[-*]\s").cast("long")).alias("bullets"), F.bool_or(F.col("text").rlike(r"(?i)^\s*(?:[-*]\s*)?tab:\s*true")).alias("tab"))


def not_vendored(files: DataFrame, vendors=VENDORS, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Files outside vendors' folders and excluded paths."""
    out = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(v) for v in vendors])))
    for p in excluded:
        out = out.where((F.col("path") != p) & ~F.startswith("path", F.lit(p + "/")))
    return out


def claimed(files: DataFrame, backends: list[tuple[str, str]]) -> DataFrame:
    """files with language: the first backend (language, extension) registered for the extension; null if none."""
    table = files.sparkSession.createDataFrame([(i, lang, ext) for i, (lang, ext) in enumerate(backends)], "ord int, language string, ext string")
    first = table.groupBy("ext").agg(F.min_by("language", "ord").alias("language"))
    return files.withColumn("ext", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).join(F.broadcast(first), "ext", "left")


def directories(files: DataFrame) -> DataFrame:
    """(node_id, parent_id, depth) of all folders above the files, the root `.` included."""
    parts = F.split("path", "/")
    each = files.select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))).alias("node_id")).distinct()
    depth = F.size(F.split("node_id", "/"))
    root = files.sparkSession.createDataFrame([(".", None, 0)], "node_id string, parent_id string, depth int")
    return root.union(each.select("node_id", F.when(depth == 1, ".").otherwise(F.regexp_extract("node_id", "^(.*)/[^/]*$", 1)).alias("parent_id"), depth.alias("depth")))


#: Where the known callees of bindings have their arguments (kind, place of the modes or 0, place of the key).
BINDERS = {
    "vim.keymap.set": ("keymap", 1, 2), "vim.api.nvim_set_keymap": ("keymap", 1, 2), "vim.api.nvim_buf_set_keymap": ("keymap", 2, 3),
    "vim.api.nvim_create_user_command": ("usercmd", 0, 1), "vim.api.nvim_buf_create_user_command": ("usercmd", 0, 2), "vim.api.nvim_create_autocmd": ("autocmd", 0, 1),
}
#: Words before a bracket that call nothing.
NO_CALLEES = ("if", "elseif", "while", "for", "return", "and", "or", "not", "function", "until", "in", "switch", "catch")
#: The most letters of a symbol's detail, and the most commits listed.
DETAIL, COMMITS = 48, 500


def doc_tags(files: DataFrame) -> DataFrame:
    """(node_id, owner, line, tag, value) of blocks of `---` lines; owner is the line below the block.

    Lines before the first tag are one row with tag `prose`; lines after @example belong to it, other lines after a
    tag to none. Blocks are runs of comment lines: a line's number less its rank among them is the same in a run.
    """
    run = Window.partitionBy("node_id").orderBy("line")
    block = Window.partitionBy("node_id", "block")
    rows = lines(files).where(F.col("text").rlike(r"^\s*---")).withColumn("block", F.col("line") - F.row_number().over(run))
    rows = rows.withColumn("name", F.regexp_extract("text", r"^\s*---\s*@([A-Za-z]+)", 1)).withColumn("owner", F.max("line").over(block) + 1)
    rows = rows.withColumn("nth", F.sum((F.col("name") != "").cast("int")).over(block.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    said = F.when(F.col("name") != "", F.regexp_extract("text", r"^\s*---\s*@[A-Za-z]+\s*(.*)$", 1)).otherwise(F.regexp_replace("text", r"^\s*---?\s?", ""))
    got = rows.withColumn("said", said).groupBy("node_id", "owner", "nth").agg(F.min("line").alias("line"), F.max("name").alias("name"), F.array_sort(F.collect_list(F.struct("line", "said"))).alias("all"))
    told = F.transform("all", lambda x: x["said"])
    body = F.when(F.col("name").isin("", "example"), F.array_join(F.when((F.col("name") == "example") & (told[0] == ""), F.slice(told, F.lit(2), F.greatest(F.size(told), F.lit(1)))).otherwise(told), "\n")).otherwise(told[0])
    return got.select("node_id", "owner", "line", F.when(F.col("name") == "", "prose").otherwise(F.col("name")).alias("tag"), body.alias("value"))


def doc_blocks(tags: DataFrame) -> DataFrame:
    """(node_id, owner, summary, params, see, todo, bug, test, deprecated, internal, example): a row for each block."""
    from sparkloom.functions.scalar import summary_of

    held = lambda t, v: F.transform(F.filter(F.array_sort(F.collect_list(F.when(F.col("tag") == t, F.struct("line", v.alias("v"))))), lambda x: x.isNotNull()), lambda x: x["v"])
    value = F.col("value")
    one = lambda t: F.max_by(F.when(F.col("tag") == t, value), F.when(F.col("tag") == t, F.col("line")))
    out = tags.groupBy("node_id", "owner").agg(
        summary_of(F.coalesce(one("prose"), F.lit(""))).alias("summary"), held("param", F.regexp_extract("value", r"^([A-Za-z_.][A-Za-z0-9_.]*)", 1)).alias("params"), held("see", value).alias("_see"),
        held("todo", value).alias("todo"), held("bug", value).alias("bug"), held("test", value).alias("test"), one("deprecated").alias("deprecated"), F.bool_or(F.col("tag") == "internal").alias("internal"), one("example").alias("example"))
    see = F.flatten(F.transform("_see", lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y))))
    return out.select("node_id", "owner", "summary", "params", see.alias("see"), "todo", "bug", "test", "deprecated", "internal", "example")


def doc_signatures(tags: DataFrame) -> DataFrame:
    """(node_id, owner, params, returns, overloads): what blocks say of types, read from @param, @return and @overload in their order."""
    from sparkloom.functions import scalar as S

    held = lambda t, v: F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == t, F.struct("line", F.col("value").alias("v"))))), lambda x: v(x["v"]))
    return tags.groupBy("node_id", "owner").agg(held("param", S.param_info).alias("params"), held("return", S.return_info).alias("returns"), held("overload", S.overload_info).alias("overloads"))


def export_name(files: DataFrame) -> DataFrame:
    """(node_id, exported): the local that the last return at the margin gives, bare or within setmetatable; null if neither."""
    pattern = r"(?m)^return\s+(?:setmetatable\s*\(\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*(?:[,)].*)?$"
    last = F.try_element_at(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.lit(-1))
    return files.select("node_id", F.when(last != "", last).alias("exported"))


def symbols(files: DataFrame) -> DataFrame:
    """(node_id, line, name, kind, detail): locals at the margin that are no functions, no requires and not what the file returns."""
    name, value = F.regexp_extract("text", r"^local\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$", 1), F.trim(F.regexp_extract("text", r"^local\s+[A-Za-z_][A-Za-z0-9_]*\s*=\s*(.*)$", 1))
    rows = lines(files).withColumn("name", name).where("name != ''").withColumn("v", value).where(~F.col("v").rlike(r"^(function\b|require\s*\(?\s*[\"'])"))
    first = rows.groupBy("node_id", "name").agg(F.min_by(F.struct("line", "v"), "line").alias("x")).select("node_id", "name", "x.line", "x.v")
    kept = first.join(export_name(files), "node_id").where("exported is null or name != exported")
    flat = F.trim(F.regexp_replace("v", r"\s+", " "))
    short = F.when(F.length(flat) > DETAIL, F.concat(F.substring(flat, 1, DETAIL - 1), F.lit("…"))).otherwise(flat)
    table, constant = F.col("v").startswith("{"), F.col("v").rlike(r"^(-?[0-9][0-9a-fA-FxX.eE+-]*|\"[^\"]*\"|'[^']*'|true|false)$")
    return kept.select("node_id", "line", "name", F.when(table, "table").when(constant, "constant").otherwise("binding").alias("kind"), F.when(table, F.when(F.col("v").rlike(r"^\{\s*\}"), "empty")).otherwise(short).alias("detail"))


def bindings(files: DataFrame, wrappers: dict[str, str] | None = None) -> DataFrame:
    """(node_id, line, kind, modes, lhs, buffer_local) of calls written on a line; wrappers: own callee -> known callee whose places it has.

    A mode list in braces gives its modes joined by commas, in order; a key that is no literal gives no row.
    """
    known = {**BINDERS, **{own: BINDERS[of] for own, of in (wrappers or {}).items() if of in BINDERS}}
    local = {own: "_buf_" in (wrappers or {}).get(own, own) for own in known}
    table = files.sparkSession.createDataFrame([(c, k, m, p, local[c]) for c, (k, m, p) in known.items()], "callee string, kind string, mode_at int, key_at int, buffer_local boolean")
    call = r"(?<![A-Za-z0-9_.:])([A-Za-z_][A-Za-z0-9_.]*)\s*\((.*)$"
    argument = r"\{[^}]*\}|\"[^\"]*\"|'[^']*'|[^,\"'{}]+"
    rows = lines(files).where(~F.col("text").rlike(r"^\s*--")).withColumn("callee", F.regexp_extract("text", call, 1)).where("callee != ''")
    args = F.filter(F.transform(F.regexp_extract_all(F.regexp_extract("text", call, 2), F.lit(argument), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    got = rows.withColumn("args", args).join(F.broadcast(table), "callee")
    at = lambda n: F.try_element_at("args", n)
    words = lambda c: F.array_join(F.regexp_extract_all(c, F.lit("[\"']([^\"']*)[\"']"), F.lit(1)), ",")
    modes = F.when(F.col("mode_at") > 0, words(at(F.greatest("mode_at", F.lit(1)))))
    return got.where(at(F.col("key_at")).rlike("^[\"'{]")).select("node_id", "line", "kind", modes.alias("modes"), words(at(F.col("key_at"))).alias("lhs"), "buffer_local")


def call_sites(files: DataFrame, spans: DataFrame, comment: str = "--") -> DataFrame:
    """(node_id, seq, line, callee, from_fn): names before a bracket; from_fn is the outermost of spans (node_id, fn_key, first, last) around the line, null outside."""
    code = lines(files).where(~F.startswith(F.trim("text"), F.lit(comment)))
    bare = F.regexp_replace("text", r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "\"\"")
    found = code.select("node_id", "line", F.posexplode(F.regexp_extract_all(bare, F.lit(r"(?<!function )(?<![A-Za-z0-9_.:])([A-Za-z_][A-Za-z0-9_]*(?:[.:][A-Za-z_][A-Za-z0-9_]*)*)\s*\("), F.lit(1))).alias("p", "callee")).where(~F.col("callee").isin(*NO_CALLEES))
    around = found.select("node_id", "line").distinct().join(spans, "node_id").where("line between first and last").groupBy("node_id", "line").agg(F.min_by("fn_key", F.struct("first", -F.col("last"))).alias("from_fn"))
    return found.join(around, ["node_id", "line"], "left").select("node_id", (F.col("line").cast("long") * 1000 + F.col("p")).alias("seq"), "line", "callee", "from_fn")


def tools(files: DataFrame) -> DataFrame:
    """(node_id, name, command, raw) of the array `tools` of a JSON file; an entry that is no object has no name."""
    entries = F.from_json("content", "struct<tools: array<string>>")["tools"]
    each = files.select("node_id", F.explode(entries).alias("raw"))
    return each.select("node_id", F.get_json_object("raw", "$.name").alias("name"), F.get_json_object("raw", "$.command").alias("command"), "raw")


def commit_list(commits: DataFrame, most: int = 50) -> DataFrame:
    """(sha, day, files): the latest commits; `most` is kept in 1 to COMMITS."""
    each = commits.groupBy("sha", "day").agg(F.countDistinct("path").alias("files"))
    return each.orderBy(F.desc("day"), F.desc("sha")).limit(max(1, min(most, COMMITS)))


def uncovered_roots(roots: DataFrame) -> DataFrame:
    """roots (path) that no other root contains: prefixes of each path meet the roots on equality."""
    own = roots.select("path").distinct()
    parts = F.split("path", "/")
    above = own.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, ".").otherwise(F.array_join(F.slice(parts, 1, n), "/")))).alias("up")).where("up != path")
    covered = above.join(own.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return own.join(covered, "path", "left_anti")


def extension_counts(files: DataFrame) -> DataFrame:
    """(ext, claimed, n) of files with a language or without, as claimed() gives them."""
    return files.groupBy("ext", F.col("language").isNotNull().alias("claimed")).agg(F.count(F.lit(1)).alias("n"))


#: Folders that hold no prose of the tree's own.
NO_PROSE = ("node_modules", ".deps")


def corpus(files: DataFrame, out_dir: str = "docs/map") -> DataFrame:
    """Markdown files of a tree, but those in folders that begin with a dot, of dependencies, and what the tool itself wrote."""
    folders = F.split(F.regexp_replace("path", "[^/]*$", ""), "/")
    own = F.col("path").startswith(out_dir.rstrip("/") + "/")
    return files.where(F.lower("path").rlike(r"\.(md|markdown)$") & ~own & ~F.exists(folders, lambda x: x.startswith(".") | x.isin(*NO_PROSE)))


def outside(files: DataFrame, roots: list[str], cap: int = 20_000) -> DataFrame:
    """(ext, n): files that no root holds, by extension; a count of `cap` says that there are so many or more."""
    held = [F.col("path").startswith(r.rstrip("/") + "/") if r not in ("", ".") else F.lit(True) for r in roots]
    out = files
    for x in held:
        out = out.where(~x)
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return out.where(ext != "").groupBy(ext.alias("ext")).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("n"))


def types_folded(files: DataFrame, folder: str = "@types") -> tuple[DataFrame, DataFrame]:
    """Files that are not in a types folder; and (path, types): for each folder that has one, how many files are in it."""
    inside = F.col("path").contains(f"/{folder}/") | F.col("path").startswith(f"{folder}/")
    owner = F.regexp_extract("path", rf"^(.*?)/?{folder}/", 1)
    return files.where(~inside), files.where(inside).groupBy(F.when(owner == "", ".").otherwise(owner).alias("path")).agg(F.count(F.lit(1)).alias("types"))


def multi_root(trees: dict[str, DataFrame]) -> DataFrame:
    """Nodes (node_id, parent_id, depth, ...) of several roots under one synthetic root `.`; ids of a root begin with its name."""
    out = None
    for name, nodes in sorted(trees.items()):
        moved = nodes.withColumns({
            "parent_id": F.when(F.col("parent_id").isNull(), ".").otherwise(F.concat(F.lit(name + ":"), "parent_id")),
            "node_id": F.concat(F.lit(name + ":"), "node_id"), "depth": F.col("depth") + 1})
        out = moved if out is None else out.unionByName(moved)
    top = out.limit(0).sparkSession.range(1).select(*[F.lit("." if c == "node_id" else 0 if c == "depth" else None).cast(out.schema[c].dataType).alias(c) for c in out.columns])
    return top.unionByName(out)


def type_edges(tags: DataFrame) -> DataFrame:
    """(node_id, src, dst, kind) of tags (node_id, owner, line, tag, value): `@class A : B, C` extends; a field's types are referred to.

    A name in a type is a capitalised dotted word; unions, arrays and generics part names. An edge is given once.
    """
    classes = tags.where("tag = 'class'").select("node_id", "line", F.regexp_extract("value", r"^(?:\([a-z]+\)\s*)?([A-Za-z_][\w.]*)", 1).alias("src"), F.regexp_extract("value", r":\s*(.*)$", 1).alias("above"))
    ups = classes.select("node_id", "src", F.explode(F.regexp_extract_all("above", F.lit(r"[A-Za-z_][\w.]*"), F.lit(0))).alias("dst"), F.lit("extends").alias("kind"))
    w = Window.partitionBy("node_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("tag") == "class", F.regexp_extract("value", r"^(?:\([a-z]+\)\s*)?([A-Za-z_][\w.]*)", 1))
    held = tags.where("tag in ('class', 'field')").withColumn("src", F.last(name, True).over(w)).where("tag = 'field' and src is not null")
    used = held.select("node_id", "src", F.explode(F.regexp_extract_all(F.regexp_extract("value", r"^\S+\s+(\S+)", 1), F.lit(r"[A-Za-z_][\w.]*"), F.lit(0))).alias("dst"), F.lit("type").alias("kind"))
    return ups.unionByName(used.where(F.col("dst").rlike("^[A-Z]|[.]"))).where("src != dst").distinct()


def plugin_specs(files: DataFrame) -> DataFrame:
    """(node_id, line, repo, lazy, triggers): tables that begin with "owner/name", or name it in `src`, up to their closing brace.

    triggers are the names under event, cmd, ft and keys, in that order; lazy is true, false or null as written. Braces
    are matched, so a table within a table (a dependency) is an entry of its own and does not lend its keys to the outer one.
    """

    def run(batches):
        import re

        import pyarrow as pa

        start = re.compile(r"\{\s*(?:src\s*=\s*)?[\"']((?:https?://[^\"'/]+/)?[\w.-]+/[\w.-]+)[\"']")
        for b in batches:
            out = []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = re.sub(r"--[^\n]*", lambda m: " " * len(m[0]), text or "")
                found = [(m, _closing(text, m.start())) for m in start.finditer(text)]
                for m, end in found:
                    body = list(text[m.end() : end])
                    for n, stop in found:
                        if m.start() < n.start() < end:
                            body[n.start() - m.end() : stop + 1 - m.end()] = " " * (min(stop + 1, end) - n.start())
                    own = "".join(body)
                    lazy = re.search(r"\blazy\s*=\s*(true|false)", own)
                    triggers = []
                    for key in ("event", "cmd", "ft", "keys"):
                        value = re.search(rf"\b{key}\s*=\s*(\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}}|\"[^\"]*\"|'[^']*')", own)
                        if value and value[1][0] == "{":
                            each = re.findall(r"\{\s*[\"']([^\"']*)", value[1][1:]) if key == "keys" and "{" in value[1][1:] else re.findall(r"[\"']([^\"']*)[\"']", value[1])
                            triggers += each
                        elif value:
                            triggers.append(value[1][1:-1])
                    out.append((node, text.count("\n", 0, m.start()) + 1, re.sub(r"^https?://[^/]+/", "", m[1]), lazy and lazy[1] == "true", triggers))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["node_id", "line", "repo", "lazy", "triggers"])

    return files.select("node_id", "content").mapInArrow(run, "node_id string, line int, repo string, lazy boolean, triggers array<string>")


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return i
    return len(text)
