"""URL filters: rules by host and path first; for the rest logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule): a host, with its subdomains, and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: So many rules are one expression; more are a table that is joined.
AS_EXPRESSION = 200
#: Lengths of n-grams; weights; labelled URLs used at most, the first by a hash of the URL.
ORDERS, BUCKETS, ROWS = (3, 4, 5), 1 << 16, 10_000
#: Characters whose n-grams are hashed at once.
STEP = 1 << 20

#: The small labelled table: names of hosts, fixed values. Each stands under several domains, subdomains and paths, so both classes have the same ones.
BLOCKED = """casino casino-royal casinobonus win-casino big-win online-slots slots-win poker-bonus freebets bet-now sports-bets best-bets jackpot-spin
lucky-spin lotto-win free-money free-prize free-gift win-prize cheap-meds buy-pills pills-online pharma-pills viagra-cheap cheap-viagra
cheap-watches replica-bags cheap-replica cheap-rolex adult-cams adult-dating adultvideo adult-xxx xxx-tube x-rated sex-cams porn-hub hot-porn porn-x
nude-cams ads-server ads-click ad-tracker ads-serve track-ads click-track trackpixel pixel-track popup-ads adserver banner-ads spam-links link-farm
spam-blast seo-spam farm-links link-spam content-farm malware-drop phish-login hack-crack crack-keys warez-free torrent-warez keygen-free
payday-loan fast-loans crypto-double get-rich miracle-diet weight-loss-pills clickbait-farm fake-id hot-singles escort-girls adult-club adult-zone
adult-pics spam-mail bulk-spam spam-king free-casino vip-casino click-ads""".split()
ALLOWED = """theatre thermal thesis theory thenation therapy thunder thistle things thorn thread station tradition notion nation motion potion lotion edition
trending tribune terrain tender treaty tower archive archives library museum gallery garden weather climate history science physics biology music
concert orchestra recipes kitchen bakery school college university student teacher lessons news daily-news herald gazette journal press-review city-
council parliament ministry hospital clinic health railway airport harbour river-walk mountain forest open-source docs wiki python-docs manual
handbook maison jardin cuisine lecture peinture histoire bibliothek zeitung schule nachrichten stadt wetter biblioteca escuela noticias ciudad cocina
blog my-blog weblog travel-notes bookshop furniture tool-box adventure advice trackway shells wheat handled earth oratorio inner thirteen relation
national readable northern southern interested anthem""".split()
DOMAINS = (".com", ".net", ".org", ".example.com", ".example.net", ".example.org")
PATHS = ("/en/1024", "/fr/77.html", "/de/3051/", "/es/9", "/index.html", "/about", "/2024/05/story", "/")
SUBDOMAINS = ("", "www.", "m.", "blog.", "shop.")
#: Nothing to judge by is no reason to block.
BARE = ("about:blank", "javascript:void(0)", "mailto:a", "tel:1", "", "x", "#top", "?q=1")


def labelled(spark: SparkSession) -> DataFrame:
    """(url, label) of the small table; label 1 is to be blocked."""
    names = [(n, 1) for n in BLOCKED] + [(n, 0) for n in ALLOWED]
    rows = [(f"http://{SUBDOMAINS[(k + j) % len(SUBDOMAINS)]}{n}{end}{PATHS[(k + 3 * j) % len(PATHS)]}", y) for k, (n, y) in enumerate(names) for j, end in enumerate(DOMAINS)]
    return spark.createDataFrame(rows + [(x, 0) for x in BARE], "url string, label int")


def parts(url) -> tuple:
    """(host, path) as columns: after the first :// up to / ? # or the end, A-Z in lower case; then up to ? # or the end. Empty without ://."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, pattern, 2)


def ruled(rows: DataFrame, rules=RULES, as_expression: int = AS_EXPRESSION) -> DataFrame:
    """rows (host, path, ...) with rule and ruling, null where none fits: the longest rule, then the one with the longer host, then the least.

    A rule fits its host and all subdomains, if the path starts with the rule's. Up to `as_expression` rules are one
    expression; more are joined: each different host and path explodes into its host's suffixes, joined by equality.
    """
    split = sorted({(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for v, r in rules}, key=lambda x: (-len(x[2]), -len(x[0]), x[2]))
    if len(split) <= as_expression:
        rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
        for host, path, name, verdict in reversed(split):
            fits = (F.concat(F.lit("."), F.col("host")).endswith("." + host)) & F.col("path").startswith(path)
            rule, ruling = F.when(fits, name).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
        return rows.select("*", rule.alias("rule"), ruling.alias("ruling"))
    table = rows.sparkSession.createDataFrame([(*x, -n) for n, x in enumerate(split)], "suffix string, start string, rule string, ruling string, rank int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = rows.select("host", "path").distinct().select("*", F.explode(suffixes).alias("suffix")).join(table, "suffix").where(F.startswith("path", "start"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "ruling"), "rank").alias("best"))
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, "best.rule", "best.ruling")


class Model:
    """A weight for each bucket, and the bias; a URL's n-grams weigh one over the root of their number."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability of label 1 of each URL; one without n-grams has the bias's."""
        out = np.zeros(len(hosts))
        for at, buckets in features(hosts, paths, len(self.weights)):
            out += np.bincount(at, weights=self.weights[buckets], minlength=len(hosts))
        return 1 / (1 + np.exp(-np.clip(self.bias + out / np.sqrt(np.maximum(1, lengths(hosts, paths))), -60, 60)))


def _marked(hosts: list[str], paths: list[str]) -> list[tuple[int, int, str]]:
    """(index, side, text) of the texts whose n-grams count: hosts (0) and paths (1) between marks that tell their ends; empty ones have none."""
    return [(k, side, f"\x02{t}\x03") for side, texts in enumerate((hosts, paths)) for k, t in enumerate(texts) if t]


def lengths(hosts: list[str], paths: list[str]) -> np.ndarray:
    """N-grams of each URL."""
    out = np.zeros(len(hosts))
    for k, _, text in _marked(hosts, paths):
        out[k] += sum(max(0, len(text) - n + 1) for n in ORDERS)
    return out


def _groups(marked: list[tuple[int, int, str]]):
    """Lists of pieces (index, side, text, characters that the piece before had too), about a million characters each."""
    group, size = [], 0
    for k, side, text in marked:
        for start in range(0, len(text), STEP):
            before = min(start, max(ORDERS) - 1)
            group.append((k, side, text[start - before : start + STEP], before))
            size += len(group[-1][2])
            if size >= STEP:
                yield group
                group, size = [], 0
    if group:
        yield group


def features(hosts: list[str], paths: list[str], buckets: int = BUCKETS):
    """(index of the URL, bucket) of all n-grams, in arrays: texts are laid end to end and hashed together."""
    for group in _groups(_marked(hosts, paths)):
        codes = np.frombuffer("".join(x[2] for x in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        sizes = np.array([len(x[2]) for x in group])
        owner, side, before = (np.repeat(np.array([x[i] for x in group]), sizes) for i in (0, 1, 3))
        end = np.repeat(np.cumsum(sizes), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for n in ORDERS:
            many = len(codes) - n + 1
            if many < 1:
                break
            hashed = side[:many].astype(np.uint64) + np.uint64(2 * n)
            for j in range(n):
                hashed = (hashed ^ codes[j : many + j]) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
            own = (np.arange(many) + n <= end[:many]) & (place[:many] + n > before[:many])
            yield owner[:many][own], (hashed[own] % np.uint64(buckets)).astype(np.int64)


def fit(table: DataFrame, buckets: int = BUCKETS, rows: int = ROWS, ridge: float = 0.02, steps: int = 400) -> Model:
    """A model from a labelled table (url, label 0 or 1), of which the first `rows` by a hash of the URL are used.

    Ridge-penalised logistic regression, classes weighted alike, by accelerated gradient descent on the driver. Null URLs and
    other labels are left out; with one class or none the model is a constant.
    """
    host, path = parts(F.col("url"))
    known = table.where("url IS NOT NULL AND label IN (0, 1)").select("url", F.col("label").cast("int").alias("label"), host.alias("host"), path.alias("path"))
    found = known.orderBy(F.xxhash64("url"), "url", "label").limit(rows).collect()
    y = np.array([r["label"] for r in found], dtype=np.float64)
    many = [float((y == 0).sum()), float((y == 1).sum())]
    if not all(many):
        return Model(np.zeros(buckets), float(np.log((many[1] + 0.5) / (many[0] + 0.5))))
    hosts, paths = [r["host"] for r in found], [r["path"] for r in found]
    pairs = [*features(hosts, paths, buckets)]
    at, to = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])
    used, column = np.unique(to, return_inverse=True)
    value = 1 / np.sqrt(np.maximum(1, lengths(hosts, paths)))[at]
    weight = np.where(y == 1, 0.5 / many[1], 0.5 / many[0])
    w, b, last, last_b = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    row_norm = np.bincount(at, weights=value, minlength=len(y)).max()
    rate = 1 / (0.25 * (row_norm + 1) + ridge)
    for k in range(steps):
        now, now_b = w + (w - last) * (k / (k + 3)), b + (b - last_b) * (k / (k + 3))
        z = now_b + np.bincount(at, weights=value * now[column], minlength=len(y))
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        last, last_b = w, b
        w, b = now - rate * (np.bincount(column, weights=value * gap[at], minlength=len(used)) + ridge / len(y) * now), now_b - rate * gap.sum()
    full = np.zeros(buckets)
    full[used] = w
    return Model(full, float(b))


def judge(pages: DataFrame, table: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row of pages: the longest rule's verdict, else block where the model's score reaches the threshold.

    table (url, label) trains the model; without one it is the small table of this module. A null URL, or one without
    ://, has an empty host and path, fits no rule and has no n-grams: its score is the bias's. Rows that repeat give a row
    each; an empty table gives none. Only the two columns are read, whatever the others are called.
    """
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(fit(labelled(spark) if table is None else table))
    host, path = parts(F.col(url_col))
    rows = ruled(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), rules)

    def score(batches):
        for b in batches:
            found = model.value.scores(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, "score"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"id {kind}, host string, path string, rule string, ruling string, score double")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruling", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
