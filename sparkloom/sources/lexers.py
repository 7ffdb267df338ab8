"""Functions of source files by lexers, in Arrow batches: Python by its own parser, others by scans (see braces)."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.braces import HEADERS, LANGUAGES, braces, ends

SCHEMA = "node_id string, fn_name string, line int, line_end int, params array<string>, summary string, complexity int, internal boolean, shape string, shape_size int"

#: How each family of languages begins a function, and what ends its block.
STARTS = {
    "lua": re.compile(r"^\s*(?:local\s+)?function\s+([\w.:]+)\s*\(([^)]*)\)|^\s*(?:local\s+)?([\w.]+)\s*=\s*function\s*\(([^)]*)\)"),
}
#: Languages whose functions are runs of clauses at the margin: how a clause begins, and a signature before it.
CLAUSES = {
    "haskell": (re.compile(r"^(?!(?:module|import|data|type|newtype|class|instance|where|infix[lr]?|deriving|foreign|default)\b)([a-z_][\w']*)((?:\s+[^\s=|:]+)*)\s*(?:[=|](?!=)|$)"), re.compile(r"^([a-z_][\w']*)\s*::")),
    "ocaml": (re.compile(r"^let\s+(?:rec\s+)?([a-z_][\w']*)((?:\s+[^\s=:]+)+?)\s*(?::[^=]+)?="), None),
    "erlang": (re.compile(r"^([a-z]\w*)\(([^)]*)\)\s*(?:when\b.*)?->"), re.compile(r"^-spec\s+([a-z]\w*)\(")),
    "asm": (re.compile(r"^([A-Za-z_][\w$@]*)()\s*:"), None),
}
#: What makes a name of such a language public, where the file lists or marks it.
EXPORTS = {
    "haskell": re.compile(r"(?s)^module\s+[\w.]+\s*\(([^)]*(?:\([^)]*\)[^)]*)*)\)\s*where", re.M),
    "erlang": re.compile(r"(?s)^-export\(\[([^\]]*)\]\)", re.M),
    "asm": re.compile(r"^\s*\.?(?:globl|global|public)\s+(.*)$", re.M | re.I),
}
BRANCH = re.compile(r"\b(?:if|elseif|elif|for|while|repeat|case|catch|except|and|or)\b|&&|\|\|")
COMMENT = {"lua": "--", "haskell": "--", "erlang": "%", "ocaml": "(*", "asm": ";"}


def _python(content: str):
    for node in ast.walk(ast.parse(content)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            doc = (ast.get_docstring(node) or "").strip().split("\n\n")[0].replace("\n", " ")
            kinds = [type(x).__name__ for x in ast.walk(node)]
            branches = sum(k in ("If", "For", "While", "ExceptHandler", "IfExp", "And", "Or", "comprehension") for k in kinds)
            yield node.name, node.lineno, node.end_lineno, [a.arg for a in node.args.args], doc, 1 + branches, node.name.startswith("_"), ".".join(kinds), len(kinds)


def _depth(text: str) -> int:
    bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|--.*", "", text)
    opened = len(re.findall(r"\b(?:function|then|do|repeat)\b", bare)) - len(re.findall(r"\belseif\b", bare))
    return opened - len(re.findall(r"\b(?:end|until)\b", bare))


def _lua(content: str):
    rows, notes = content.split("\n"), []
    for i, row in enumerate(rows):
        if row.strip().startswith("--"):
            notes.append(row.strip().lstrip("-").strip())
            continue
        m = STARTS["lua"].match(row)
        if m:
            g = [x for x in m.groups() if x is not None]
            depth, end = 0, i
            for j in range(i, len(rows)):
                depth += _depth(rows[j])
                if depth <= 0:
                    end = j
                    break
            body = re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|--[^\n]*", " ", "\n".join(rows[i : end + 1]))
            tokens = re.findall(r"[A-Za-z_]\w*|\d+|[^\s\w]", body)
            shape = ["n" if t[0].isalpha() or t[0] == "_" else "d" if t[0].isdigit() else t for t in tokens]
            params = [p.strip() for p in (g[1] if len(g) > 1 else "").split(",") if p.strip()]
            yield g[0], i + 1, end + 1, params, next((n for n in notes if n and not n.startswith("@")), ""), 1 + len(BRANCH.findall(body)), "local" in row.split("function")[0] or g[0].startswith("_"), "".join(shape), len(shape)
        notes = []


def _clauses(content: str, language: str):
    """Functions written as clauses at the margin; a function ends before the next line at the margin that is not its own."""
    start, sign = CLAUSES[language]
    rows, notes, found, at = content.split("\n"), [], {}, None
    listed = EXPORTS.get(language)
    public = set(re.findall(r"[A-Za-z_][\w$']*", " ".join(listed.findall(content)))) if listed else set()
    limited = bool(listed and listed.search(content))
    for i, row in enumerate(rows):
        if row.strip().startswith(COMMENT[language]):
            notes.append(row.strip().lstrip("-%;(*# |").removesuffix("*)").strip())
            continue
        m, s = start.match(row), sign.match(row) if sign else None
        if s and not m:
            at = None
            continue
        if m:
            name, given = m[1], m[2] or ""
            params = [x.strip() for x in (given.split(",") if language == "erlang" else given.split()) if x.strip()]
            if name not in found:
                found[name] = [i, i, params, next((n for n in notes if n), "")]
            at = name
        elif row[:1].strip() and language != "asm":
            at = None
        if at and row.strip():
            found[at][1] = i
        if row.strip():
            notes = []
    for name, (first, last, params, note) in found.items():
        tokens = re.findall(r"[A-Za-z_][\w']*|\d+|[^\s\w]", "\n".join(rows[first : last + 1]))
        shape = ["n" if t[0].isalpha() or t[0] == "_" else "d" if t[0].isdigit() else t for t in tokens]
        hidden = name not in public if limited or language == "asm" else False
        yield name, first + 1, last + 1, params, note, 1 + sum(bool(BRANCH.fullmatch(t)) for t in tokens), hidden, "".join(shape), len(shape)


def _of(text: str, language: str | None, path: str | None):
    if language == "python":
        return _python(text)
    if language == "lua":
        return _lua(text)
    if language in CLAUSES:
        return _clauses(text, language)
    if language in ("ruby", "elixir"):
        return ends(text, language)
    return braces(text, language, bool(path) and path.rsplit(".", 1)[-1] in HEADERS) if language in LANGUAGES else ()


def functions(files: DataFrame) -> DataFrame:
    """files (node_id, language, content, and path, where there) to functions, in the order of lines; a file that cannot be parsed gives none.

    In C and C++ a path with a header's extension makes prototypes functions; other languages do not ask for the path.
    """
    with_path = files if "path" in files.columns else files.withColumn("path", F.lit(None).cast("string"))

    def run(batches):
        for b in batches:
            out = []
            for i, lang, text, path in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    found = list(_of(text or "", lang, path))
                except (SyntaxError, ValueError, RecursionError):
                    found = []
                out += [(i, *x) for x in sorted(found, key=lambda x: (x[1], x[0]))]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int32()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True)], names=names)

    return with_path.select("node_id", "language", "content", "path").mapInArrow(run, SCHEMA)
