"""Scalar functions of the engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Summaries end after so many characters.
SUMMARY_CAP = 160


def bare_name(name: Column) -> Column:
    """The last run of word characters, else the name."""
    last = F.regexp_extract(name, r"([A-Za-z0-9_]+)$", 1)
    return F.when(last != "", last).otherwise(name)


def pct(part: Column, whole: Column) -> Column:
    """Percent with one decimal, half up; 0 over nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(1000 * part / whole + 0.5) / 10)


def normalised(path: Column) -> Column:
    """A path without `.` and empty parts, and with `..` taken back."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def dotted_prefixes(name: Column) -> Column:
    """All prefixes of a dotted name, the whole name last."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def declared_params(signature: Column) -> Column:
    """The names between the first parentheses; commas part them."""
    inside = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")


def balanced(pieces: Column, sep: str) -> Column:
    """Neighbouring pieces joined by sep until as many brackets are closed as were opened: parts in which no bracket is left open.

    A fold over pieces and not over characters; what is open at the end is the last part.
    """
    count = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))

    def step(a, x):
        now = F.when(a["open"].isNull(), x).otherwise(F.concat(a["open"], F.lit(sep), x))
        depth = a["depth"] + count(x, "({<") - count(x, ")}>")
        whole = depth <= 0
        return F.struct(F.when(whole, F.array_append(a["done"], now)).otherwise(a["done"]).alias("done"), F.when(~whole, now).alias("open"), F.when(whole, 0).otherwise(depth).alias("depth"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def typed(text: Column) -> Column:
    """(type, rest) of `type rest`: the first blank outside brackets parts them."""
    parts = balanced(F.split(text, " "), " ")
    return F.struct(F.get(parts, F.lit(0)).alias("type"), F.ltrim(F.array_join(F.slice(parts, 2, 1 << 30), " ")).alias("rest"))


def param_info(value: Column) -> Column:
    """(name, type, optional, desc) of a @param's text; a `?` after the name or the type makes it optional."""
    name = F.regexp_extract(value, r"^(\S+)", 1)
    both = typed(F.regexp_extract(value, r"^\S+\s*([\s\S]*)$", 1))
    bare = lambda c: F.regexp_replace(c, r"\?$", "")
    return F.struct(bare(name).alias("name"), bare(both["type"]).alias("type"), (name.endswith("?") | both["type"].endswith("?")).alias("optional"), both["rest"].alias("desc"))


def return_info(value: Column) -> Column:
    """(type, name, desc) of a @return's text; name null where no word follows the type."""
    both = typed(value)
    name = F.regexp_extract(both["rest"], r"^([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.struct(both["type"].alias("type"), F.when(name != "", name).alias("name"), F.regexp_replace(both["rest"], r"^[A-Za-z_][A-Za-z0-9_]*\s*", "").alias("desc"))


def overload_info(value: Column) -> Column:
    """(params, returns) of an @overload's text `fun(a: T, b?: U): R, S`; both empty where it is no function type or is not closed."""
    commas = lambda c: F.filter(F.transform(balanced(F.split(c, ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    head = F.get(balanced(F.transform(F.split(value, r"\)"), lambda x: F.concat(x, F.lit(")"))), ""), F.lit(0))
    closed = value.rlike(r"^fun\s*\(") & (F.length(F.translate(head, "({<", "")) == F.length(F.translate(head, ")}>", ""))) & value.startswith(head)
    inside = F.regexp_replace(F.regexp_replace(head, r"^fun\s*\(", ""), r"\)$", "")
    after = F.regexp_replace(F.substr(value, F.length(head) + 1), r"^\s*:\s*", "")

    def one(x):
        name = F.regexp_extract(x, r"^([A-Za-z0-9_.?]+)\s*:", 1)
        kind = F.when(name == "", x).otherwise(F.regexp_replace(x, r"^[A-Za-z0-9_.?]+\s*:\s*", ""))
        return F.struct(F.when(name == "", "_").otherwise(F.regexp_replace(name, r"\?$", "")).alias("name"), kind.alias("type"), name.endswith("?").alias("optional"))

    none = F.array().cast("array<string>")
    return F.struct(F.transform(F.when(closed, commas(inside)).otherwise(none), one).alias("params"), F.when(closed, commas(after)).otherwise(none).alias("returns"))


def documented(summary: Column, internal: Column, declared: Column, params: Column, method: Column, judged: Column) -> Column:
    """Whether a function counts as documented: not internal, a summary, and its declared parameters named in order."""
    named = F.when(method & (F.get(params, 0) == "self"), F.slice(params, F.lit(2), F.greatest(F.size(params), F.lit(1)))).otherwise(params)
    plain = F.filter(declared, lambda x: x != "...")
    common = F.least(F.size(declared), F.size(named))
    fits = F.forall(F.when(common > 0, F.sequence(F.lit(0), common - 1)).otherwise(F.array().cast("array<int>")), lambda i: (F.get(declared, i) == "...") | (F.get(declared, i) == F.get(named, i)))
    return ~internal & (F.coalesce(summary, F.lit("")) != "") & (~judged | ((F.size(plain) <= F.size(named)) & fits))


def summary_of(prose: Column) -> Column:
    """The first sentence of the first paragraph, on one line, cut at SUMMARY_CAP characters."""
    first = F.trim(F.regexp_replace(F.split(F.trim(prose), r"\n\s*\n", 2)[0], r"\s+", " "))
    ended = F.regexp_extract(first, r"^(.*?[.!?])(?: |$)", 1)
    line = F.when(ended != "", ended).otherwise(first)
    return F.when(F.length(line) > SUMMARY_CAP, F.concat(F.rtrim(F.substring(line, 1, SUMMARY_CAP - 1)), F.lit("…"))).otherwise(line)


def route_path(url: Column) -> Column:
    """Of a request's URL: the path, without host, base variable, query and fragment; `/` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^\{\{[^{}]*\}\}", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(bare, r"[?#].*$", "")
    return F.when(path == "", "/").otherwise(path)


def route_pattern(route: Column) -> Column:
    """A regular expression for a route: `:name` and `{name}` are one segment, a last slash is free."""
    quoted = F.regexp_replace(F.regexp_replace(route, r"\{[^}/]*\}|:[A-Za-z_][A-Za-z0-9_]*", "\x01"), r"([.+*?^$()\[\]|\\{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(quoted, "/$", ""), F.lit("\x01"), F.lit("[^/]+")), F.lit("/?$"))


def escaped_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]|<>])", r"\\$1")


def escaped_label(text: Column) -> Column:
    """For quoted labels of graph formats."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def percent_decoded(text: Column) -> Column:
    """A part of a URL with %xx and + read back; as it is where that is not well formed."""
    return F.coalesce(F.try_url_decode(text), text)


def safe_sha(text: Column) -> Column:
    """A commit's hash of 4 to 40 hexadecimal digits, in lower case; null for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{4,40}$"), F.lower(text))


def static_name(text: Column) -> Column:
    """A name of letters, digits, dots, dashes and underscores that does not begin with a dot; null for anything else."""
    return F.when(text.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]*$"), text)


def shape_hash(shape: Column) -> Column:
    """A shape as 16 hexadecimal digits; 64 bits of SHA-256."""
    return F.substring(F.sha2(shape, 256), 1, 16)
