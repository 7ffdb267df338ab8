"""Prefix trie, URL filters and filter audit against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np

CONV = "conv_id long, turn int, role string, text string, depth string, a string, n string, run string"
JUNK = ("j1", "j2", "j3", "j4")


def plain_trie(rows):
    """Nodes as tuples of turns, each figure by walking all nodes."""

    def digest(role, text):
        h = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        return tuple((int(h[i : i + 16], 16) + (1 << 63)) % (1 << 64) - (1 << 63) for i in (0, 16))

    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(head, [])[:h] + mine[h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[hash(p[:d]), d].append(c)
    at = {k: (min(m), len(m), sum(len(paths[c]) == k[1] for c in m)) for k, m in nodes.items()}
    kids = defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p)):
            kids[hash(p[:d]), d].add((hash(p[: d + 1]), d + 1))
    out, below = set(), {}
    for k in sorted(nodes, key=lambda k: -k[1]):
        owner, n, _ = at[k]
        chars = len(paths[owner][k[1] - 1][1]) if k[1] else 0
        leaves, saved = 0 if kids[k] else 1, (n - 1) * chars
        for x in kids[k]:
            leaves, saved = leaves + below[x][0], saved + below[x][1]
        below[k] = leaves, saved
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(paths[c]) == k[1])
        parent = at[hash(paths[owner][: k[1] - 1]), k[1] - 1][0] if k[1] else None
        out.add((owner, k[1], parent, n, len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_prefix_trie_against_plain_python(spark):
    """Shared and repeated paths, heads that are absent or short, null turns, roles and texts, ties, a conversation of several runs, ids of several blocks."""
    from sparkloom.llm.prefixes import prefix_trie

    r = random.Random(4)
    rows = []
    for c in [*range(0, 12), *range(100, 130), *range(270, 300), *range(65500, 65620), *range(-205, -190), 10**12, 10**12 + 1]:
        kind = r.randrange(6)
        for t in range(r.randrange(1, 8)):
            rows.append((c, t, "user" if t % 2 else "bot", f"hé{kind if t < 3 else r.randrange(3)} {t}" * r.randrange(1, 3 if t > 4 else 2), *JUNK))
    rows += [(c, None, None, "x", *JUNK) for c in (3, 101, 102)] + [(104, 2, "user", w, *JUNK) for w in ("tie", "eit", "tie", None, "")]
    rows += [(None, 1, "user", "nobody", *JUNK), (65600, None, None, None, *JUNK), (65600, None, "", "", *JUNK)]
    rows += [(7, k, "user", f"turn {k}", *JUNK) for k in range(8, 2600)] + [(8, k, "user", f"turn {k}", *JUNK) for k in range(8, 1500)]
    r.shuffle(rows)
    got = prefix_trie(spark.createDataFrame(rows, CONV).repartition(5)).collect()
    assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == plain_trie(rows)


def test_prefix_trie_of_nothing_and_of_copies(spark):
    from sparkloom.llm.prefixes import prefix_trie

    assert prefix_trie(spark.createDataFrame([], CONV)).collect() == []
    rows = [(c, t, "user", "same " * 1000, *JUNK) for c in range(1, 99) for t in (0, 1)]
    got = {tuple(x) for x in prefix_trie(spark.createDataFrame(rows, CONV)).collect()}
    assert got == plain_trie(rows)
    assert sum(x[3] for x in got if x[1] == 0) == 98


URL_ROWS = [
    "https://Casino-Win.Example.COM/de/1?x=/fr/",
    "http://a.b.example.org/es/9#top",
    "http://example.org/en/12",
    "http://notexample.org/es/1",
    "ftp://org/",
    "http://org",
    "x://y://z/fr/",
    "http://shop.com/fr/2",
    "http://shop.com/FR/2",
    "no scheme",
    None,
    "",
    "http://",
    "http:///de/",
    "http://host.com\n/de/x y",
    "http://ÄÖ.com/de/é",
    "http://" + "long-host-" * 400_000 + ".net/" + "free-pills/" * 300_000,
    "http://www.theatre.example.net/en/5",
    "http://www.theatre.example.net/en/5",
    "http://cheap-casino-pills.example.net/en/5",
]


def plain_url(u):
    host, path = "", ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, path


def plain_rule(host, path, rules):
    fits = [(len(r), len(r.split("/")[0]), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, key=lambda x: x[:2], default=(0, 0, None, None))
    return best[2:]


def test_urls_are_judged_by_rules_then_by_the_model(spark):
    from sparkloom.llm import urls as U

    pages = spark.createDataFrame([(k, u, "h", "p", "r", 0.5) for k, u in enumerate(URL_ROWS)], "page_id long, url string, host string, path string, rule string, score double")
    got = sorted(U.judge(pages).collect())
    model = U.fit(U.labelled(spark))
    assert len(got) == len(URL_ROWS)
    for row, u in zip(got, URL_ROWS, strict=True):
        host, path = plain_url(u)
        rule, verdict = plain_rule(host, path, U.RULES)
        z, n = 0.0, 0
        if len(host) < 1000:
            for side, text in ((0, host), (1, path)):
                marked = f"\x02{text}\x03" if text else ""
                for size in U.ORDERS:
                    for i in range(len(marked) - size + 1):
                        h = side + 2 * size
                        for c in marked[i : i + size]:
                            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                            h ^= h >> 29
                        z, n = z + float(model.weights[h % U.BUCKETS]), n + 1
            assert abs(row.score - 1 / (1 + np.exp(-(model.bias + z / max(1, n) ** 0.5)))) < 1e-6
        assert (row.host, row.path, row.rule) == (host, path, rule) and row.verdict == (verdict or ("block" if row.score >= 0.5 else "allow"))
    assert got[10].verdict == got[11].verdict == "allow" and got[17].verdict == "allow" and got[19].verdict == "block"
    assert U.judge(pages.limit(0)).collect() == []


def test_long_urls_give_each_gram_once(spark, monkeypatch):
    from sparkloom.llm import urls as U

    hosts, paths = ["ab" * 50, "c", ""], ["/x" * 40, "", "/é"]
    count = lambda: sorted((int(a), int(b)) for x, y in U.features(hosts, paths) for a, b in zip(x, y, strict=True))
    whole = count()
    assert [sum(a == k for a, _ in whole) for k in range(3)] == list(U.lengths(hosts, paths))
    monkeypatch.setattr(U, "STEP", 7)
    assert count() == whole


def test_many_rules_are_joined(spark):
    from sparkloom.llm import urls as U

    rules = [(v, f"{h}/{p}") for k, h in enumerate(("com", "b.com", "a.b.com", "c.com")) for p in ("", "x", "x/y", "z" * k) for v in (("allow", "block")[(k + len(p)) % 2],)]
    rows = spark.createDataFrame([(h, p) for h in ("com", "b.com", "q.a.b.com", "xb.com", "c.com", "", "d.net") for p in ("", "/", "/x", "/x/yy", "/zzz", "/q")] * 2, "host string, path string")
    one, two = (sorted(map(tuple, U.ruled(rows, rules, n).collect()), key=str) for n in (200, 0))
    assert one == two and len(one) == rows.count()
    assert {x[:3] for x in one} == {(h, p, plain_rule(h, p, rules)[0]) for h, p, *_ in one}


def test_url_model_on_names_it_has_not_seen(spark, monkeypatch):
    """Every fifth name left out of the table: three quarters of those to be blocked are, and one in twenty of the others at most."""
    from sparkloom.llm import urls as U

    hit, false = [], []
    blocked, allowed = U.BLOCKED, U.ALLOWED
    for fold in range(5):
        monkeypatch.setattr(U, "BLOCKED", [n for i, n in enumerate(blocked) if i % 5 != fold])
        monkeypatch.setattr(U, "ALLOWED", [n for i, n in enumerate(allowed) if i % 5 != fold])
        model = U.fit(U.labelled(spark))
        for names, out in ((blocked, hit), (allowed, false)):
            out += [model.scores([f"{n}.example.net"], ["/en/77"])[0] >= 0.5 for i, n in enumerate(names) if i % 5 == fold]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.05


def test_url_model_of_one_class(spark):
    from sparkloom.llm import urls as U

    one = U.fit(spark.createDataFrame([("http://a.com/", 0), (None, 1), ("http://b.com/", None), ("http://c.com/", 7)], "url string, label int"))
    assert one.scores(["x.com"], ["/"])[0] < 0.5 and not one.weights.any()


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        docs[part or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out, removed = [], defaultdict(int)
    for part, each in docs.items():
        for order in itertools.permutations("ABCDE"):
            left = each
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[0]]
                kept = [x for x in left if f not in x[0]]
                removed[part, f] += len(here)
                out.append((part, "".join(order), step, len(kept), len(here), sum(f in x[0] for x in each) - len(here), sum(x[0] == {f} for x in each), sum(x[1] for x in here), sum(x[2] for x in here)))
                left = kept
    return {(*x, removed[x[0], x[1][x[2] - 1]]) for x in out}


def test_filter_audit_against_plain_python(spark):
    """Null ids, texts and parts, an empty part, repeated rows, copies, labels that repeat or miss, names that clash."""
    from sparkloom.llm.audit import audit

    r = random.Random(2)
    texts = [None, "", "  \n\t ", "one", "A B C", "x" * 100_000]
    for _ in range(60):
        vocab = [f"w{k}é" for k in range(r.choice((20, 90, 400)))]
        text = " ".join(r.choice(vocab) for _ in range(r.choice((10, 199, 200, 300))))
        texts.append(text + r.choice(("", " # ", "\x0bend", " * Q", " ABC" * 30)))
    rows = [(None if r.random() < 0.1 else r.randrange(150), r.choice(texts), r.choice(("en", "de", None, ""))) for _ in range(250)]
    rows += [rows[5], rows[5], (7, "one", "en"), (7, "one", "en"), (8, "one", "xx")]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1))) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame([(i, t, p, 1, "u", "v", b"w") for i, t, p in rows], "doc_id long, text string, lang string, n int, part string, words string, sha binary")
    known = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, mask string")
    got = [tuple(x) for x in audit(d, known).collect()]
    assert len(got) == 600 * len({p or "" for _, _, p in rows}) and set(got) == plain_audit(rows, labels)
    assert audit(d.limit(0), known).collect() == []
    alone = {tuple(x) for x in audit(d, known.limit(0)).collect()}
    assert alone == plain_audit(rows, [])


def test_words_do_not_cross_the_network(spark):
    """One exchange deals texts out; both counts of words lie above it without another."""
    from pyspark.sql import functions as F

    from sparkloom.llm.audit import word_counts

    d = spark.createDataFrame([(1, "a b a")], "id long, text string")
    texts = d.select("id", "text", F.unhex(F.sha2("text", 256)).alias("sha")).groupBy("sha").agg(F.any_value("text").alias("text"), F.min("id").alias("least"))
    plan = word_counts(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and word_counts(texts).select("words", "distinct").collect() == [(3, 2)]


def test_shards_swap_within_their_room():
    """No shard takes in more than its room and what leaves it; where all are full, circles of moves are granted whole."""
    from sparkloom.llm.sharding import granted

    r = random.Random(8)
    for _ in range(50):
        n = r.randrange(2, 9)
        asked = {(s, t): [r.randrange(1, 5) for _ in range(r.randrange(1, 4))] for s in range(n) for t in range(n) if s != t and r.random() < 0.5}
        spare = [r.choice((0, 0, 3, 50)) for _ in range(n)]
        take = granted(asked, spare)
        flow = {k: sum(asked[k][:m]) for k, m in take.items()}
        for t in range(n):
            assert sum(v for k, v in flow.items() if k[1] == t) - sum(v for k, v in flow.items() if k[0] == t) <= spare[t]
    ring = {(0, 1): [4], (1, 2): [4], (2, 0): [4], (3, 0): [2]}
    assert granted(ring, [0, 0, 0, 0]) == {(0, 1): 1, (1, 2): 1, (2, 0): 1, (3, 0): 0}


def test_propagation_and_not_the_start_brings_copies_together(spark):
    from sparkloom.llm.sharding import cut_edges, shard

    rows = [(i, f"pair {i // 2}" if i < 1200 else f"t{i}") for i in range(2000)]
    trace: list[int] = []
    sharded = shard(spark.createDataFrame(rows, "doc_id long, text string"), 10, trace=trace)
    assert max(trace) > 480 and trace[-1] == 0 and cut_edges(sharded).head()["cut"] == 0
