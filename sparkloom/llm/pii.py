"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base kinds, in their order, then the further kinds of this method.
BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "secret")
#: The patterns as the contract has them (further kinds: our own).
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9])+",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9_-]{20,}",
}
#: Lengths of account numbers by country.
LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_OF_LENGTH = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in LENGTHS.items()) + ")(?![A-Za-z0-9])"
#: The same languages with possessive repeats: no recursion on long runs, no second try from inside a run.
#: Account numbers end at their country's length where one is there, so a word in capitals after them does not spoil them.
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_OF_LENGTH}|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_OF_LENGTH})\x20?[A-Z0-9])++)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: What a match must look like whole, beside the checksums.
SHAPES = {
    "ip": r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$",
    "card": r"^([\x20-]?[0-9]){16,19}$",
    "iban": r"^(\x20?[A-Z0-9]){15,34}$",
    "secret": r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]",
}
#: Words near a span that make it likelier, and those that make a span of a further kind less likely.
CONTEXT = {
    "email": "mail|contact|correo|courriel",
    "ip": "host|server|addr|login",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
    "secret": "token|secret|password|passwd|api.?key|access.?key|private.?key|bearer|credential",
}
AGAINST = {"iban": "sample|placeholder|dummy", "ssn": "serial|invoice|part no|version", "secret": "commit|checksum|digest|revision|sha-?256|md5|uuid"}
#: A span's score with words against it alone, with none or both, and with words for it alone.
SCORES = {"email": (0.8, 0.8, 0.95), "ip": (0.6, 0.6, 0.8), "card": (0.8, 0.8, 0.95), "phone": (0.6, 0.6, 0.85), "iban": (0.45, 0.8, 0.95), "ssn": (0.1, 0.3, 0.75), "secret": (0.1, 0.3, 0.8)}
NEAR, LEAST = 40, 0.5
CHUNK = 128


def _sums(lengths):
    """Inclusive prefix sums of an array, in chunks, so that the work stays near linear in its length."""
    add = lambda a, x: a + x
    count = F.size(lengths)
    whole = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)), F.lit(0), add))
    before = F.aggregate(whole, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.transform(lengths, lambda x, i: F.get(before, F.floor(i / CHUNK).cast("int")) + F.aggregate(F.slice(lengths, (F.floor(i / CHUNK) * CHUNK).cast("int") + 1, (i % CHUNK) + 1), F.lit(0), add))


def _luhn(digits):
    """True where the Luhn sum of a string of digits ends in 0."""
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _mod97(code):
    """True where an account number, its first four characters moved to the end, leaves 1 by 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    values = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.conv(F.substring(moved, i, F.lit(1)), 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _valid(kind: str, match, before, after):
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(SHAPES["ip"])
    if kind == "card":
        return F.when(match.rlike(SHAPES["card"]), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return F.when(match.rlike(SHAPES["iban"]) & ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]"), _mod97(F.regexp_replace(match, " ", ""))).otherwise(False)
    if kind == "ssn":
        return ~before.rlike("[0-9-]$") & ~after.rlike("^[0-9-]")
    return F.lit(True)


def _gate(kind: str, text):
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "secret":
        return F.lower(text).rlike(CONTEXT[kind])
    return F.lit(True)


def _likely(kind: str, matches):
    """Of the matches alone: whether one can pass; so that few texts are cut into pieces."""
    return F.exists(matches, lambda m: m.rlike(SHAPES[kind])) if kind in SHAPES else F.size(matches) > 0


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, text, spans array of (kind, start, end, score)) for each row of docs; code points, end exclusive.

    All is done within the row, in the JVM: matches by regexp_extract_all, positions from the lengths of the pieces
    that split leaves between them; no shuffle. Spans stand by kind (base kinds first), then start. Base spans that
    pass their checks always stay; spans of further kinds stay at a score of `least` or more, which nearby words
    raise or lower. Null text counts as empty and has no spans. Rows with equal ids are treated one by one.
    """
    kinds = (*BASE, *MORE)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text, none = F.col("_text"), F.array().cast("array<string>")
    rows = rows.select("_id", "_text", *[F.when(_gate(k, text), F.regexp_extract_all(text, F.lit(LINEAR[k]), F.lit(0))).otherwise(none).alias(f"m_{k}") for k in kinds])
    rows = rows.select("*", *[F.when(_likely(k, F.col(f"m_{k}")), F.split(text, LINEAR[k], -1)).alias(f"p_{k}") for k in kinds])

    def starts(k: str):
        pieces, matches = F.col(f"p_{k}"), F.col(f"m_{k}")
        return F.when(pieces.isNotNull(), _sums(F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.when(i == 0, 0).otherwise(F.length(F.get(matches, i - 1))))))

    rows = rows.select("*", *[starts(k).alias(f"s_{k}") for k in kinds])

    def spans(k: str):
        pieces, matches = F.col(f"p_{k}"), F.col(f"m_{k}")

        def one(m, i):
            before, after = F.right(F.get(pieces, i), F.lit(NEAR)), F.left(F.get(pieces, i + 1), F.lit(NEAR))
            start = F.get(F.col(f"s_{k}"), i)
            has = lambda words: F.lower(before).rlike(words) | F.lower(after).rlike(words)
            near, against = has(CONTEXT[k]), has(AGAINST[k]) if k in AGAINST else F.lit(False)
            score = F.when(near & ~against, SCORES[k][2]).when(against & ~near, SCORES[k][0]).otherwise(SCORES[k][1])
            ok = _valid(k, m, before, after)
            return F.when(ok if k in BASE else ok & (score >= least), F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score")))

        found = F.filter(F.transform(matches, one), lambda x: x.isNotNull())
        return F.when(pieces.isNotNull(), found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))

    return rows.select(F.col("_id").alias(id_col), text.alias(text_col), F.concat(*[spans(k) for k in kinds]).alias("spans"))


def redacted(found: DataFrame, text_col: str = "text") -> DataFrame:
    """found, as from pii_spans, with each span in the text replaced by its kind in brackets; of overlapping spans the first."""
    ordered = F.array_sort(F.col("spans"), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):
        cut = F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].alias("at"), cut.alias("out")))

    text = F.aggregate(ordered, begin, step, lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, F.length(text_col))))
    return found.withColumn(text_col, text)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of pii_spans: n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, scores (of the spans, in their order)."""
    found = pii_spans(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(id_col, *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("secret"), F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"))


def _sql(kind: str) -> str:
    """DuckDB's list of (start, end) of one kind, from text t."""
    p = PATTERNS[kind].replace("'", "''")
    digits = "regexp_replace(m[i], '[^0-9]', '', 'g')"
    back = lambda text, n: f"right({text}, {n})"
    has = lambda words: f"(regexp_matches(lower({back('p[i]', NEAR)}), '{words}') OR regexp_matches(lower(left(p[i + 1], {NEAR})), '{words}'))"
    near, against = has(CONTEXT[kind]), has(AGAINST[kind]) if kind in AGAINST else "false"
    low, middle, high = (f"{x:.2f}" for x in SCORES[kind])
    score = f"CASE WHEN {near} AND NOT {against} THEN '{high}' WHEN {against} AND NOT {near} THEN '{low}' ELSE '{middle}' END"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse({digits}), j, 1)::INT ELSE (substr(reverse({digits}), j, 1)::INT * 2) // 10 + (substr(reverse({digits}), j, 1)::INT * 2) % 10 END)) % 10 = 0"
    code = "replace(m[i], ' ', '')"
    moved = f"(substr({code}, 5) || substr({code}, 1, 4))"
    mod97 = f"list_reduce(list_transform(range(1, len({code}) + 1), lambda j: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({moved}, j, 1)) - 1), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"
    ok = {
        "email": "true",
        "ip": f"regexp_matches(m[i], '{SHAPES['ip']}')",
        "card": f"CASE WHEN regexp_matches(m[i], '{SHAPES['card']}') THEN {luhn} ELSE false END",
        "phone": f"len({digits}) BETWEEN 8 AND 15",
        "iban": f"CASE WHEN regexp_matches(m[i], '{SHAPES['iban']}') AND NOT regexp_matches(p[i], '[A-Za-z0-9]$') AND NOT regexp_matches(p[i + 1], '^[A-Za-z0-9]') THEN {mod97} ELSE false END AND NOT ({against} AND NOT {near})",
        "ssn": f"NOT regexp_matches(p[i], '[0-9-]$') AND NOT regexp_matches(p[i + 1], '^[0-9-]') AND {near} AND NOT {against}",
        "secret": f"regexp_matches(m[i], '{SHAPES['secret']}') AND {near} AND NOT {against}",
    }[kind]
    return f"""{kind} AS (SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN {ok} THEN
        '{kind}:' || (list_sum(list_transform(p[1:i], lambda s: len(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: len(s))), 0))::BIGINT
        || ':' || (list_sum(list_transform(p[1:i], lambda s: len(s))) + list_sum(list_transform(m[1:i], lambda s: len(s))))::BIGINT || ':' || {score} END), lambda s: s IS NOT NULL) AS s
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM t))"""


def oracle() -> str:
    kinds = (*BASE, *MORE)
    joins = " ".join(f"JOIN {k} ON t.doc_id = {k}.doc_id" for k in kinds)
    part = lambda ks, p: "array_to_string(list_transform(" + " || ".join(f"{k}.s" for k in ks) + f", lambda x: regexp_extract(x, '{p}', 1)), ',')"
    joined = lambda ks: part(ks, "^(.*):[0-9.]+$")
    counts = ", ".join(f"len({k}.s) AS n_{k}" for k in BASE)
    return f"WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(map(_sql, kinds))} SELECT t.doc_id, {counts}, sha256({joined(BASE)}) AS base_sha256, {joined(kinds)} AS spans, len(secret.s) AS n_secret, {part(kinds, ':([0-9.]+)$')} AS scores FROM t {joins}"
