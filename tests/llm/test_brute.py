"""The document operators against plain Python: rows that share ids or have none, clashing names, models, draws, the pipeline."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

ODD = "doc_id long, text string, lang string, source string, n_chars long, _covered string, _runs string, _own_sha string, id string, k string, row string, `a.b` string, c0 string"
EXTRA = ("u1", "u2", "u3", "u4", "u5", "u6", "u7", "u8")


def odd(rows):
    """rows (id, text, lang, source) with columns whose names operators might use inside."""
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows]


def test_line_dedup_tells_rows_apart(spark):
    """Other texts under one id keep their own lines; rows without an id take part; the order is id, then digest."""
    from sparkloom.llm.line_dedup import line_dedup

    rows = [(1, "a\nb\nc\nd"), (5, "a\nb\nc\nz"), (5, "x\ny\nq"), (None, "n\na\nb\nc"), (None, "p\nq\nr"), (None, "o\np\nq\nr"), (7, None), (8, ""), (9, "x\ny\nq"), (9, "x\ny\nq")]
    d = spark.createDataFrame(odd([(i, t, "en", "s") for i, t in rows]), ODD)
    got = line_dedup(d).collect()
    assert got[0].asDict().keys() == {*d.columns, "n_lines", "n_removed"} and all(r[5:13] == EXTRA for r in got)
    have = Counter((r.doc_id, r.text, r.n_removed) for r in got)
    assert have[(1, "a\nb\nc\nd", 0)] == have[(5, "z", 3)] == have[(5, "x\ny\nq", 0)] == have[(None, "n", 3)] == have[(7, None, 0)] == have[(8, "", 0)] == 1
    assert have[(9, "", 3)] == 2
    assert have[(None, "p\nq\nr", 0)] + have[(None, "o\np\nq\nr", 0)] == 1 and have[(None, "", 3)] + have[(None, "o", 3)] == 1


def test_operators_keep_columns_of_any_name(spark):
    from sparkloom.llm.exact_dedup import exact_dedup
    from sparkloom.llm.mixing import mixed_documents
    from sparkloom.llm.simhash import simhash_dedup

    rows = odd([(1, "one two three four five", "en", "s"), (2, "one two three four five", "en", None), (None, "other words are here", None, "s"), (3, None, "en", "s")])
    d = spark.createDataFrame(rows, ODD)
    for made in (exact_dedup(d), mixed_documents(d, block=2), simhash_dedup(d)):
        got = made.collect()
        assert made.columns == d.columns and got and all(r[5:13] == EXTRA for r in got)
    assert sorted(map(tuple, exact_dedup(d).collect()), key=str) == sorted((rows[0], rows[2], rows[3]), key=str)


def test_exact_dedup_chooses_the_same_row_again(spark):
    from sparkloom.llm.exact_dedup import exact_dedup

    rows = [(1, "a", lang) for lang in "xyzxyz"] + [(None, "a", "w"), (2, "b", "x"), (3, "b", "y")]
    for keep, want in (("min", {("b", 2)}), ("max", {("b", 3)})):
        a, b = (sorted(map(tuple, exact_dedup(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(n), keep=keep).collect())) for x, n in ((rows, 1), (rows[::-1], 3)))
        assert a == b and {(r[1], r[0]) for r in a} == want | {("a", 1)}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_simhash_dedup_against_brute_force(spark):
    """Groups over two fingerprints of the different words; one row of each group stays, the smallest id, null ids last."""
    from sparkloom.llm import simhash as m

    r = random.Random(9)
    vocab = [f"w{k}" for k in range(4000)]
    base = [[r.choice(vocab) for _ in range(r.randint(60, 300))] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [edited(r, base[k % 8], 1 + k % 4) for k in range(60)] + [None, "", "a b"]
    rows = [(None if i % 13 == 5 else i // 2 if i % 17 == 3 else i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[0], rows[45], (45, texts[3] + " x", "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def bits(t, seed):
        h = [xxhash.xxh64_intdigest(x.encode(), seed) for x in set((t or "").lower().split())]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    kinds = sorted({(x[0], x[1]) for x in rows}, key=str)
    fps = [[bits(t, s) for s in m.SEEDS] for _, t in kinds]
    top = list(range(len(kinds)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(kinds)):
        for j in range(i):
            if any((a ^ b).bit_count() <= 3 for a, b in zip(fps[i], fps[j], strict=True)):
                top[root(i)] = root(j)
    groups = defaultdict(list)
    for i, kind in enumerate(kinds):
        groups[root(i)].append(kind)
    got = m.simhash_dedup(d).collect()
    assert len(got) == len(groups) < len(kinds) - 40
    left = Counter((x.doc_id, x.text) for x in got)
    for members in groups.values():
        stay = [k for k in members if left[k]]
        ids = [k[0] for k in members if k[0] is not None]
        assert len(stay) == 1 and left[stay[0]] == 1 and stay[0][0] == (min(ids) if ids else None)
    assert m.simhash_dedup(d.limit(0)).isEmpty()


def kneser_ney(texts):
    """Modified Kneser-Ney of bytes, order 5, in plain Python: a function (bytes before, byte) -> probability."""
    tables = [Counter() for _ in range(6)]
    for t in texts:
        data = b"\n" * 4 + t
        for i in range(4, len(data)):
            tables[5][data[i - 4 : i + 1]] += 1
    for order in (4, 3, 2, 1):
        for gram in tables[order + 1]:
            tables[order][gram[1:]] += 1
    cuts, totals, kinds = {}, {}, {}
    for order in range(1, 6):
        n = Counter(tables[order].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        cuts[order] = [min(0.95 * k, max(0.1 * k, k - (k + 1) * y * n[k + 1] / n[k])) if y is not None and n[k] else 0.5 * k for k in (1, 2, 3)]
        totals[order], kinds[order] = Counter(), defaultdict(Counter)
        for gram, c in tables[order].items():
            totals[order][gram[:-1]] += c
            kinds[order][gram[:-1]][min(c, 3)] += 1

    def p(before, byte, order):
        if not order:
            return 1 / 256
        context = before[len(before) - order + 1 :] if order > 1 else b""
        lower = p(before, byte, order - 1)
        total = totals[order][context]
        if not total:
            return lower
        c = tables[order][context + bytes([byte])]
        back = sum(cuts[order][k - 1] * m for k, m in kinds[order][context].items()) / total
        return (c - cuts[order][min(c, 3) - 1] if c else 0) / total + back * lower

    return lambda before, byte: p(before, byte, 5)


def test_quality_against_plain_kneser_ney(spark):
    """Each text is scored by the texts of the other half; perplexity and bands are those of plain Python; both paths agree to the last bit."""
    from sparkloom.llm import quality as q

    r = random.Random(4)
    words = {"en": ["the", "ship", "of", "and", "land", "stone", "river", "under"], "fr": ["le", "été", "aux", "pierre", "sous", "navire"]}
    rows = [(i, " ".join(r.choices(words[x], k=60 + i)), x) for i, x in ((i, "en" if i % 3 else "fr") for i in range(40))]
    rows += [(2, "zq xj " * 40, "en"), (None, "stone river land " * 30, None), (None, rows[1][1], "en"), (50, "", "en"), (51, None, "fr"), (52, " ".join("".join(r.choices("bcdfgxq", k=6)) for _ in range(70)), "en"), rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (sorted(map(tuple, q.quality(d, sent=x).collect()), key=str) for x in (10**9, 0))
    assert a == b and len(a) == len(rows)
    half = lambda t: xxhash.xxh64_intdigest(t.encode(), 5) % 2
    models = {(x, h): kneser_ney([t.lower().encode() for _, t, y in rows if t and y == x and half(t) == h]) for x in ("en", "fr", None) for h in (0, 1)}
    logs = {}
    for i, t, x in rows:
        if t:
            model, data = models[x, 1 - half(t)], b"\n" * 4 + t.lower().encode()
            logs[i, t, x] = -sum(math.log(model(data[k - 4 : k], data[k])) for k in range(4, len(data))) / (len(data) - 4)
    ends = {}
    for x in ("en", "fr", None):
        each = sorted(math.floor(logs[row] * q.STEPS) for row in rows if row[1] and row[2] == x and not q.base_failed(*(q.base_counts(row[1])[k] for k in (0, 4))))
        if each:
            q1, q3 = (each[math.ceil(part * len(each)) - 1] / q.STEPS for part in (0.25, 0.75))
            wide = max(q3 - q1, 0.025) * q.BAND
            ends[x] = q1 - wide, q3 + wide
    found = Counter()
    for row in q.quality(d).collect():
        same = [k for k in logs if k[0] == row.doc_id and abs(math.exp(logs[k]) - row.perplexity) < 1e-4 * row.perplexity] if row.perplexity else []
        assert (row.perplexity is None) == (row.n_words == 0) and (row.perplexity is None or len(same) >= 1)
        for k in same[:1]:
            low, high = ends.get(k[2], (0, 0))
            assert row.kept == (not row.base_failed and low - 1e-5 <= logs[k] <= high + 1e-5), (row, k, low, high)
            found[row.kept] += 1
    assert found[True] > 20 and not next(x.kept for x in q.quality(d).collect() if x.doc_id == 52)


def test_language_code_lengths(spark):
    """Trees give the lengths of a plain walk down the contexts with method C escapes."""
    from sparkloom.llm import langid

    r = random.Random(2)
    texts = {"aa": ["".join(r.choices("abc d", k=300)) for _ in range(3)], "bb": ["".join(r.choices("bcé d", k=300)) for _ in range(3)]}
    counts = {}
    for lang, each in texts.items():
        c = Counter(int(k) for t in each for part in langid._grams(t) for k in part)
        counts[lang] = np.array(sorted(c)), np.array([c[k] for k in sorted(c)])
    trees = langid.Trees(counts)
    for text in ("abcab d", "zzz é", "", "a" * 50, texts["bb"][0][:80]):
        want = []
        for lang in trees.names:
            seen = [defaultdict(Counter) for _ in range(4)]
            for t in texts[lang]:
                data = b" " * 3 + t.lower().encode()
                for i in range(3, len(data)):
                    for k in range(4):
                        seen[k][data[i - k : i]][data[i]] += 1
            data, total = b" " * 3 + text.lower().encode(), 0.0
            for i in range(3, len(data)):
                for k in (3, 2, 1, 0):
                    here = seen[k][data[i - k : i]]
                    if not here:
                        continue
                    n, kinds = sum(here.values()), len(here)
                    if here[data[i]]:
                        total -= math.log(here[data[i]] / (n + kinds))
                        break
                    total -= math.log(kinds / (n + kinds))
                else:
                    total += math.log(256)
            want.append(total)
        assert np.allclose(trees.lengths(text), want, rtol=1e-5, atol=1e-4), text


def test_toxicity_is_a_linear_score():
    """score is the logistic of the bias and the weights of the n-grams that occur, each once."""
    from sparkloom.llm import toxicity

    def hashes(text):
        codes = [32 if ord(x) <= 32 else ord(x) for x in f" {text.lower()} "]
        for n in (3, 4, 5):
            for i in range(len(codes) - n + 1):
                h = codes[i]
                for k in range(2, n + 1):
                    h = (h * 0x9E3779B97F4A7C15 + codes[i + k - 1] + k) % 2**64
                yield h ^ (h >> 32)

    texts = ["An idiot, an idiot!", "", "Plain words\n only", "x", "clown é😀 " * 40]
    known = sorted({h for t in texts[:4] for h in hashes(t)})[::2]
    weights = np.random.default_rng(1).normal(size=len(known))
    model = toxicity.Model(np.array(known, dtype=np.uint64), weights, -0.3)
    of = dict(zip(known, weights, strict=True))
    for t in texts:
        z = -0.3 + sum(of.get(h, 0.0) for h in set(hashes(t)))
        assert abs(model.score(t) - 1 / (1 + math.exp(-z))) < 1e-9


def test_draws_and_slots():
    """Parts of the tree agree with the whole; shards are even; slots give the target to the word."""
    from sparkloom.llm import mixing as m

    counts = [70, 0, 333, 5]
    whole = list(m.draws(counts, 9, 0, 9))
    assert whole == [x for k in range(9) for x in m.draws(counts, 9, k, k + 1)] == [*m.draws(counts, 9, 0, 4), *m.draws(counts, 9, 4, 9)]
    end = [0] * 4
    for i, _, a, b in whole:
        assert a == end[i] and b > a
        end[i] = b
    assert end == counts and {sum(b - a for _, s, a, b in whole if s == k) for k in range(9)} <= {45, 46}
    big = [4 * 10**9, 10**9, 1]
    each = [Counter() for _ in range(4)]
    for i, s, a, b in m.draws(big, 4, 0, 4):
        each[s][i] += b - a
    assert sum((Counter(x) for x in each), Counter()) == Counter(dict(enumerate(big))) and all(abs(x[0] / sum(x.values()) - 0.8) < 1e-3 for x in each)
    for size, target, block in ((1000, 700.4, 64), (1000, 1000, 64), (1000, 2000, 64), (1, 2, 8), (77, 100, 77), (640, 639, 64), (5, 0, 4)):
        n, last = m.slots(size, target, 3, block)
        count = -(-size // block)
        words = lambda b: min(block, size - b * block)  # noqa: B023, E731
        order = [int(b) for e in (0, 1) for b in m.permuted(np.arange(count), count, m._key(3, e, m.SEED))]
        got = [words(b) for b in order[:n]]
        assert sum(got[:-1]) + (min(last, got[-1]) if got else 0) == round(target), (size, target)


def mixed(rows, block, per_shard):
    """What the mix takes of each row, in plain Python: {row: [(epoch, first word, words), ...]}."""
    from sparkloom.llm import mixing as m

    def key(*values):
        text = "".join("n" if v is None else f"{len(str(v))}:{v}" for v in values)
        import hashlib

        return hashlib.sha256(text.encode()).digest()

    words = {row: len((row[1] or "").split()) for row in rows}
    names = sorted({row[3] for row in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words[x] for x in rows if x[3] == s) for s in names]
    aims = m.targets(sizes, [m.WEIGHTS[i % 3] for i in range(len(names))])
    out = {row: [] for row in rows}
    for sid, name in enumerate(names):
        order = []
        for row in rows:
            if row[3] == name and words[row]:
                k = key(row[0], row[3], row[1])
                h = xxhash.xxh64_intdigest(struct.pack("<i", m.SEED), xxhash.xxh64_intdigest(k, 42))
                order.append(((h - (1 << 64) if h >> 63 else h) % m.BUCKETS, k, row))
        stream = [(row, i) for _, _, row in sorted(order, key=lambda x: x[:2]) for i in range(words[row])]
        n, last = m.slots(sizes[sid], aims[sid], sid, block)
        count = -(-sizes[sid] // block) if sizes[sid] else 0
        for slot in range(n):
            at = int(m.permuted(np.array([slot % count]), count, m._key(sid, slot // count, m.SEED))[0])
            part = stream[at * block : (at + 1) * block][: last if slot == n - 1 else block]
            for row, i in part:
                out[row].append((slot // count, i))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() over rows that are toxic, copies, near copies, without ids, under shared ids: each stage's decision in plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as c
    from sparkloom.llm import simhash, toxicity

    r = random.Random(11)
    vocab = [f"word{k}" for k in range(3000)]
    rows = []
    for i in range(260):
        words = [r.choice(vocab) for _ in range(r.randint(40, 120))]
        if i % 5 == 0:
            words[3] = words[7] = "idiot"
        rows.append((i, " ".join(words), "en", ["a", "b", None][i % 3], 0))
    rows += [(1000 + k, rows[k][1], "en", "a", 0) for k in (1, 2, 3)]
    rows += [(2000 + k, edited(r, rows[k][1].split(), 1), "en", "b", 0) for k in range(1, 40) if k % 5]
    rows += [(None, "no id " + rows[7][1], "en", "a", 0), (None, "idiot " + rows[8][1] + " idiot", "en", "a", 0), (4, "under the id of another row " + rows[9][1][:100], "en", None, 0), (3000, None, "en", "b", 0), (3001, "", None, "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    model = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    clean = [x for x in rows if model.score(x[1]) < 0.5]
    assert len(rows) - len(clean) >= 50 and all(x in clean or "idiot" in x[1] for x in rows)
    best = {}
    for x in clean:
        t = x[1] or ""
        if t not in best or (x[0] is None, x[0] or 0) < (best[t][0] is None, best[t][0] or 0):
            best[t] = x
    once = list(best.values())
    fps = [[simhash.fingerprint(x[1], 1, s, True) for s in simhash.SEEDS] for x in once]
    top = list(range(len(once)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(once)):
        for j in range(i):
            if any(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in zip(fps[i], fps[j], strict=True)):
                top[root(i)] = root(j)
    groups = defaultdict(list)
    for i, x in enumerate(once):
        groups[root(i)].append(x)
    stay = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    assert len(once) - len(stay) >= 20
    taken = mixed([tuple(x) for x in stay], 256, 16384)
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for row, got in taken.items():
        if not got:
            continue
        words, lines = row[1].split(), []
        for at, (epoch, i) in enumerate(sorted(got)):
            if at and last == (epoch, i - 1):  # noqa: F821
                lines[-1].append(words[i])
            else:
                lines.append([words[i]])
            last = epoch, i  # noqa: F841
        ids = [*tokens.encode("\n".join(map(" ".join, lines)), add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[row[0], s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids)] += 1
    out = c.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in out) == want
    used = defaultdict(list)
    for x in out:
        used[x.sequence_id].append((x.offset, x.length))
    for parts in used.values():
        parts = sorted(parts)
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048


@pytest.mark.parametrize("seed", range(4))
def test_patterns_are_shortest_pack_first(seed):
    """As many packs of each fill as when each length, longest first, goes to the pack with the most room; what fits none opens packs of its own."""
    from sparkloom.llm.packing import patterns

    r = random.Random(seed)
    h = {n: r.randint(1, 40) for n in r.sample(range(1, 101), 25)}
    packs = []
    for n in sorted(h, reverse=True):
        for k in range(h[n]):
            room = max(packs, key=lambda p: 100 - sum(p), default=None)
            if room is None or 100 - sum(room) < n:
                packs += [[n] for _ in range(h[n] - k)]
                break
            room.append(n)
    got = [sum(p) for p, c in patterns(h, 100) for _ in range(c)]
    assert Counter(x for p, c in patterns(h, 100) for x in p for _ in range(c)) == Counter(h)
    assert sorted(got) == sorted(map(sum, packs))
