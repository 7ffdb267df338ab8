"""Functions of languages whose blocks stand in braces, and of those whose blocks end with `end`, by one scan of the text.

Comments, and strings between their quotes, are blanked first (line breaks stay), so a brace in either counts for nothing. The scan keeps a
stack of scopes; what stands between the last break and an opening brace is a head, which begins a type, a function
or another block. Functions are found at the top and in types, not inside other functions.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: How each language joins a type's name and a member's; those whose statements end with the line; line comments.
JOIN = dict.fromkeys(("go", "java", "csharp", "dart", "kotlin", "scala", "swift", "javascript", "typescript", "tsx"), ".") | {"rust": "::", "php": "::"}
BY_LINE = {"go", "kotlin", "scala", "swift", "javascript", "typescript", "tsx"}
LANGUAGES = {*JOIN, "c", "cpp", "zig"}
HEADERS = ("h", "hh", "hpp", "hxx", "h++", "inc")
#: Words that begin a block and are no function's name.
NO_NAMES = set("if for while switch catch return else do new throw sizeof synchronized using lock foreach fixed when match try guard defer case assert super this await yield elseif decltype alignas static_assert print".split())
TYPES = re.compile(r"\b(class|struct|interface|enum|trait|impl|object|extension|namespace|record|protocol|mixin|union|module|mod|actor)\b(?!\s*[:=.(])")
#: How a function's head reads where a word begins it; groups: receiver, name, parameters start.
WORDED = {
    "go": r"\bfunc\s*(\([^()]*\))?\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\(",
    "rust": r"\bfn()\s+([A-Za-z_]\w*)\s*(?:<.*?>)?\s*\(",
    "zig": r"\bfn()\s+([A-Za-z_]\w*)\s*\(",
    "kotlin": r"\bfun\s*(?:<[^>]*>\s*)?((?:[\w<>?]+\.)*)([A-Za-z_]\w*)\s*\(",
    "swift": r"\b(?:func\s+()([A-Za-z_]\w*)|()(init)\b[?!]?)\s*(?:<[^>]*>)?\s*\(",
    "scala": r"\bdef()\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\(?",
    "php": r"\bfunction()\s+&?\s*([A-Za-z_]\w*)\s*\(",
}
SCRIPT = re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\(|(?:\b(?:const|let|var)\s+|^\s*(?:module\.)?exports\.|^\s*(?:static\s+|readonly\s+|public\s+|private\s+|protected\s+)*)([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b[^(]*)?\(")
PLAIN = re.compile(r"([~#]?[A-Za-z_$][\w$]*(?:(?:::|\.)~?[A-Za-z_]\w*)*|operator\s*[^\s\w(]+)\s*(?:<[^<>(]*>)?\s*\(")
BRANCH = re.compile(r"\b(?:if|elseif|elif|elsif|unless|for|foreach|while|repeat|case|catch|except|rescue|when|guard)\b|&&|\|\||\s\?\s")


class Found(NamedTuple):
    name: str
    line: int
    line_end: int
    params: list[str]
    summary: str
    complexity: int
    internal: bool
    shape: str
    shape_size: int


def blanked(text: str, language: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with strings and comments as spaces, and the comments: (start, end, text)."""
    lines = r"#[^\n]*|//[^\n]*" if language == "php" else r"#[^\n]*" if language in ("ruby", "elixir") else r"//[^\n]*"
    blocks = r"/\*.*?(?:\*/|\Z)|" if language in LANGUAGES and language != "zig" else ""
    quotes = r'"""(?s:.*?)(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|`(?:\\.|[^`\\])*`?' if language in ("javascript", "typescript", "tsx", "go", "scala", "kotlin", "swift", "dart", "java", "elixir") else r'"(?:\\.|[^"\\])*"?'
    single = r"|'(?:\\.|[^'\\\n])*'" if language not in ("rust", "scala") else r"|'(?:\\.[^']*|[^'\\\n])'"
    comments: list[tuple[int, int, str]] = []

    def clear(m: re.Match) -> str:
        if m[0][0] in "/#":
            comments.append((m.start(), m.end(), m[0]))
            return re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]

    return re.sub(f"(?s:{blocks[:-1]})|{lines}|{quotes}{single}" if blocks else f"{lines}|{quotes}{single}", clear, text), comments


def _prose(comments: list[tuple[int, int, str]], text: str, at: int) -> str:
    """The first sentence of the comment that ends right above a position (annotations between do no harm); not a licence, not code."""
    parts, edge = [], at
    for start, end, raw in reversed([c for c in comments if c[1] <= at]):
        between = text[end:edge]
        if between.count("\n") > 1 + sum(1 for x in between.split("\n") if x.strip().startswith(("@", "[", "#["))) or re.sub(r"(?m)^\s*(?:@[\w.]+(?:\([^)]*\))?|#?\[[^\]\n]*\])\s*$", "", between).strip():
            break
        parts.insert(0, raw)
        edge = start
        if raw.startswith("/*"):
            break
    lines = [re.sub(r"^\s*(?:/\*+!?|\*+/|\*|//[/!]?|#+)?\s?|\s*\*+/\s*$", "", x) for raw in parts for x in raw.split("\n")]
    body = "\n".join(lines)
    brief = re.search(r"[@\\]brief\s+(.*)", body) or re.search(r"<summary>\s*(.*?)\s*(?:</summary>|$)", body, re.S)
    prose = brief[1] if brief else re.split(r"(?m)^\s*(?:[@\\]\w|- Parameter|- Returns|<)", body.strip())[0]
    first = re.sub(r"\s+", " ", re.split(r"\n\s*\n", prose.strip())[0]).strip()
    if re.search(r"[;{]$", first):
        return ""
    sentence = re.match(r"(.*?[.!?])(?: |$)", first)
    return sentence[1] if sentence else first


def _cut(text: str) -> list[str]:
    """What commas at the top level part."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[i - 1] not in "-="))
        if c == "," and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def params_of(inside: str, language: str) -> list[str]:
    """Names of parameters: before the colon, the first word (go), or the last word before a default."""
    if language in ("c", "cpp") and inside.strip() == "void":
        return []
    if language in ("dart", "javascript", "typescript", "tsx"):
        inside = re.sub(r"[{}\[\]]", " ", inside)
    pieces, out = _cut(inside), []
    if language == "go" and pieces and all(len(p.split()) == 1 for p in pieces):
        return []
    for p in pieces:
        p = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*|#?\[[^\]]*\]\s*)+", "", p).split("=")[0].strip()
        if language == "dart":
            p = p.split("this.")[-1]
        if language in ("rust", "kotlin", "swift", "scala", "zig", "typescript", "tsx", "javascript"):
            words = p.split(":")[0].replace("?", " ").split()
            name = words[-1] if words else ""
        elif language == "go":
            name = p.split()[0]
        else:
            words = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"\[[^\]]*\]|\(\*?(\w*)\)\s*\([^)]*\)", r" \1", p))
            name = words[-1] if words else ""
        name = re.sub(r"^(?:mut\s+|&|\.\.\.|\$|\*|'\w+\s*)+", "", name).lstrip("$&*.")
        if name and name not in ("self", "this"):
            out.append(name)
    return out


def _balanced(text: str, at: int) -> int:
    """Where the parenthesis that opens at a position is closed; the text's end if it is not."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return i
    return len(text)


def _head(head: str, language: str, owner: str | None, kind: str | None = None) -> tuple[str, str, str] | None:
    """(receiver, name, inside of the parentheses) of a head that begins a function."""
    if language in WORDED:
        bare = language == "go" and kind == "interface"
        m = re.match(r"\s*()([A-Za-z_]\w*)\s*\(", head) if bare else re.search(WORDED[language], head)
        if not m:
            return None
        name = next(i for i in range(len(m.groups()), 0, -1) if m[i] is not None)
        opened = head.find("(", m.end() - 1)
        inside = head[opened + 1 : _balanced(head, opened)] if 0 <= opened <= m.end() else ""
        return m[name - 1] or "", m[name], inside
    if language in ("javascript", "typescript", "tsx"):
        m = SCRIPT.search(head)
        if m and (m[1] or "=>" in head or "function" in head):
            return "", m[1] or m[2], head[m.end() : _balanced(head, m.end() - 1)]
        if owner is None or "=" in head.split("(")[0]:
            return None
    for m in PLAIN.finditer(head):
        name, end = m[1], _balanced(head, m.end() - 1)
        before = head[: m.start()]
        if name.split("::")[-1] in NO_NAMES or before.rstrip().endswith(("=", ".", "->", "new", "return", "@", "#")) or re.search(r"@[\w.]*$", before):
            continue
        if "=" in before or (language in ("java", "csharp", "dart", "c") or language == "cpp") and not before.strip() and owner is None and "::" not in name:
            return None
        after = head[end + 1 :].strip()
        if after and language in ("c", "cpp") and not re.match(r"(?:const|noexcept|override|final|volatile|&|:|->|=|__|throw|requires|try)", after):
            return None
        return "", name, head[m.end() : end]
    return None


def _hidden(head: str, name: str, language: str, scope: dict | None) -> bool:
    """Whether a function is not part of what its file publishes."""
    bare, words = re.split(r"\.|::", name)[-1], set(re.findall(r"\w+", head.split("(")[0]))
    held = scope["kind"] if scope else None
    if language == "go":
        return not bare[:1].isupper() or bool(re.match(r"(?:Test|Benchmark|Example)[A-Z]", bare))
    if language in ("rust", "zig"):
        return not (re.search(r"\bpub\b(?!\s*\()", head) or held == "trait" or (scope or {}).get("of_trait"))
    if language == "dart":
        return bare.startswith("_")
    if language == "java":
        return "public" not in words and held != "interface"
    if language == "csharp":
        return words & {"private", "protected", "internal"} != set() or ("public" not in words and held != "interface")
    if language == "swift":
        return not words & {"public", "open"} and held != "protocol"
    if language == "c":
        return "static" in words
    if language == "cpp":
        return "static" in words and held is None or (scope or {}).get("access") in ("private", "protected")
    return bool(words & {"private", "protected", "internal"}) or bare.startswith("#") or (language in ("javascript", "typescript", "tsx") and bare.startswith("_"))


def _made(text: str, clean: str, name: str, start: int, end: int, inside: str, language: str, hidden: bool, comments) -> Found:
    body = clean[start : end + 1]
    tokens = re.findall(r"[A-Za-z_]\w*|\d+|[^\s\w]", body)
    shape = ["n" if t[0].isalpha() or t[0] == "_" else "d" if t[0].isdigit() else t for t in tokens]
    return Found(name, clean.count("\n", 0, start) + 1, clean.count("\n", 0, end) + 1, params_of(inside, language), _prose(comments, text, start), 1 + len(BRANCH.findall(body)), hidden, "".join(shape), len(shape))


def braces(text: str, language: str, header: bool = False) -> list[Found]:
    """Functions of a source in braces; in a header (C, C++) prototypes are functions too, as in interfaces everywhere."""
    clean, comments = blanked(text, language)
    if language in ("c", "cpp"):
        clean = re.sub(r"(?m)^[ \t]*#(?:[^\n]*\\\n)*[^\n]*$", lambda m: re.sub(r"[^\n]", " ", m[0]), clean)
    out: list[Found] = []
    stack: list[dict] = []
    start, depth = 0, 0

    def owner() -> dict | None:
        return next((s for s in reversed(stack) if s["kind"] not in ("block", "inner", "namespace")), None)

    def qualified(name: str, receiver: str) -> str:
        own, joint = owner(), JOIN.get(language)
        if language == "go" and receiver:
            return re.sub(r"[()*]|\[.*", " ", receiver).split()[-1] + "." + name
        if language == "kotlin" and receiver:
            name = receiver + name
        if not own or not joint or own["kind"] == "function" or (language == "java" and name == own["name"]):
            return name
        return own["name"] + joint + name

    def began(at: int) -> int:
        """Where the head that starts at `at` has its first word."""
        return at + len(clean[at:]) - len(clean[at:].lstrip())

    def member(head: str, first: int, last: int) -> None:
        own = owner()
        if own and own["kind"] == "function":
            return
        got = _head(head, language, own["name"] if own else None, own["kind"] if own else None)
        if got:
            name = qualified(got[1], got[0])
            out.append(_made(text, clean, name, began(first), last, got[2], language, _hidden(head, name, language, own), comments))

    def ended(at: int) -> None:
        """A head that ends without a block: a prototype, or a body that is an expression."""
        head, own = clean[start:at], owner()
        kind = own["kind"] if own else None
        if kind == "function" or not head.strip():
            return
        arrow = "=>" in head or (language in ("kotlin", "scala") and re.search(r"[^=!<>]=[^=]", head))
        declared = kind in ("interface", "trait", "protocol") or header or (kind in ("class", "struct", "mixin", "abstract", "impl") and language in ("cpp", "java", "dart", "csharp", "scala", "kotlin", "php"))
        if arrow or declared:
            member(head, start, at)

    for m in re.finditer(r"[{}();\n:]", clean):
        c, i = m[0], m.start()
        if c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
        elif c == ":" and language == "cpp" and re.fullmatch(r"\s*(public|private|protected)\s*", clean[start:i]):
            if stack:
                stack[-1]["access"] = clean[start:i].strip()
            start = i + 1
        elif c == "{":
            if depth:  # a block within parentheses is part of the head
                stack.append({"kind": "inner", "depth": depth})
                continue
            head, own = clean[start:i], owner()
            kind = TYPES.search(head.split("(")[0] if language not in ("rust", "scala") else re.split(r"\bfn\b|\bdef\b", head)[0])
            scope = {"kind": "block", "name": None, "start": start}
            go = re.search(r"\btype\s+(\w+)\s*(?:\[[^\]]*\])?\s*(struct|interface)\b", head) if language == "go" else None
            if own and own["kind"] == "function":
                pass
            elif go:
                scope |= {"kind": go[2], "name": go[1]}
            elif kind and language != "go" and not (language in ("c", "cpp") and re.search(r"\)\s*$", head)):
                word = kind[1]
                rest = head[kind.end() :]
                named = re.search(r"(?:<[^>]*>\s*)?(?:(?:\w+(?:::|<[^>]*>)?)+\s+for\s+)?([A-Za-z_][\w.]*)", rest)
                word = {"record": "class", "object": "class", "extension": "class", "actor": "class", "union": "struct", "module": "namespace", "mixin": "class"}.get(word, word)
                if language in ("java", "csharp") and re.search(r"\benum\s+class\b", head):
                    word = "enum"
                if language == "rust" and word == "mod":
                    word = "class"
                scope |= {"kind": "namespace" if word == "mod" else word, "name": named[1] if named else None, "of_trait": bool(re.search(r"\bfor\b", rest)), "access": "private" if word == "class" else None}
                if scope["name"] is None and scope["kind"] != "namespace":
                    scope["kind"] = "block"
            else:
                got = _head(head, language, own["name"] if own else None, own["kind"] if own else None)
                if got:
                    name = qualified(got[1], got[0])
                    scope |= {"kind": "function", "name": name, "inside": got[2], "hidden": _hidden(head, name, language, own)}
            stack.append(scope)
            start = i + 1
        elif c == "}":
            if stack and stack[-1]["kind"] == "inner":
                depth = stack.pop()["depth"]
                continue
            if stack:
                if not depth and stack[-1]["kind"] in ("interface", "trait", "protocol"):
                    ended(i)
                scope, depth = stack.pop(), 0
                if scope["kind"] == "function":
                    out.append(_made(text, clean, scope["name"], began(scope["start"]), i, scope["inside"], language, scope["hidden"], comments))
            start = i + 1
        elif c == ";" and not depth:
            ended(i)
            start = i + 1
        elif c == "\n" and not depth and language in BY_LINE and clean[start:i].strip():
            after = clean[i:].lstrip()[:2]
            open_ended = re.search(r"(?:[=,.(|&+]|=>)\s*$", clean[start:i]) or after[:1] in (".", "{", "?") or after in ("=>", "||", "&&") or re.fullmatch(r"\s*(?:@[\w.]+\s*)+", clean[start:i])
            if not open_ended:
                ended(i)
                start = i + 1
    return sorted(out, key=lambda f: (f.line, f.name))


#: Words that open a block which `end` closes, where they begin a statement.
OPENS = {
    "ruby": re.compile(r"^\s*(?:private\s+|public\s+|protected\s+)?(?:def|class|module|if|unless|case|while|until|for|begin)\b|(?:=|\breturn)\s*(?:if|unless|case|begin|while)\b|^(?!\s*(?:while|until|for)\b).*\bdo\b"),
    "elixir": re.compile(r"\bdo\b(?!:)|\bfn\b"),
}


def ends(text: str, language: str) -> list[Found]:
    """Functions of ruby and elixir: a line's words open blocks, `end` closes them; names carry their modules."""
    clean, comments = blanked(text, language)
    rows, offsets = clean.split("\n"), [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row) + 1)
    out, stack = [], []
    for i, row in enumerate(rows):
        module = re.match(r"\s*(?:defmodule|class|module)\s+([A-Z][\w.:]*)", row)
        start = re.match(r"\s*((?:private|public|protected)\s+)?def(p|macrop?)?\s+(self\.)?([\w.?!=]+|[^\w\s(]+)\s*(?:\(([^)]*)\)|([^=]*?))?\s*(?:,?\s*do\b.*|=.*|when\b.*)?$", row.split(";")[0]) if not module else None
        access = re.match(r"\s*(private|public|protected)\s*$", row)
        if access and stack:
            stack[-1]["access"] = access[1]
        held = [s for s in stack if s["kind"] == "module"]
        inside = any(s["kind"] == "function" for s in stack)
        opened = len(OPENS[language].findall(row))
        scope = {"kind": "block", "name": None, "line": i}
        if module:
            scope |= {"kind": "module", "name": module[1], "access": "public"}
        elif start and not inside:
            sep = "." if language == "elixir" or start[3] else "#"
            name = ("." if language == "elixir" else "::").join(s["name"] for s in held) + (sep if held else "") + start[4]
            hidden = start[2] in ("p", "macrop") if language == "elixir" else bool(start[1]) and start[1].strip() != "public" or (not start[3] and bool(held) and held[-1]["access"] != "public")
            given = [re.split(r"\\\\|[:=]", x)[0].strip().lstrip("*&") for x in _cut(start[5] if start[5] is not None else start[6] or "")]
            scope |= {"kind": "function", "name": name, "hidden": hidden, "given": [x for x in given if x]}
        for k in range(opened):
            stack.append(scope if not k else {"kind": "block", "name": None, "line": i})
        closed = len(re.findall(r"(?<![\w.:])end\b(?![:?!])", row))
        if scope["kind"] == "function" and not opened:
            out.append(_row(text, clean, scope, i, i, offsets, comments))
        for _ in range(closed):
            if stack:
                done = stack.pop()
                if done["kind"] == "function":
                    out.append(_row(text, clean, done, done["line"], i, offsets, comments))
    return sorted(out, key=lambda f: (f.line, f.name))


def _row(text: str, clean: str, scope: dict, first: int, last: int, offsets: list[int], comments) -> Found:
    made = _made(text, clean, scope["name"], offsets[first], offsets[last + 1] - 2 if offsets[last + 1] - 2 > offsets[first] else offsets[first], "", "ruby", scope["hidden"], comments)
    doc = re.search(r'@doc\s+(?:"""\s*\n\s*([^\n]*)|"([^"]*)")\s*(?:\n(?:(?!\bdef|\bend\b)[^\n])*)*$', text[: offsets[first]])
    return made._replace(params=scope["given"], line_end=last + 1, summary=(doc[1] or doc[2] or "").strip() if doc else made.summary)
