"""The document operators against plain Python on small tables: nulls, empty and odd texts, ties, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, n_lines string"


def made(n=60):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "été", "Straße"]
    out = []
    for i in range(n):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 9))]
        out.append("\n".join(lines))
    out[5], out[17], out[30] = out[4], out[4], out[4]
    out[7] = out[6] + " extra"
    out[8] = "same one\nsame two\nsame three\nsame four\n" + out[8]
    out[9] = out[9] + "\nsame one\nsame two\nsame three\nsame four"
    out[10], out[11], out[12], out[13] = None, "", "   \n ", "x" * 60000
    out[14] = "Mail a.b@c.org or 4111 1111 1111 1111, +1 (555) 010-9999 at 10.0.0.255. IBAN GB82 WEST 1234 5698 7654 32, x@y z 999.1.1.1"
    return [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4] if i % 5 else "b", 0, "k", "n") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, none, spark):
    from sparkloom.llm.exact_dedup import exact_dedup, exact_groups

    best, size = {}, Counter()
    for i, t, *_ in made():
        best[t or ""] = max(best.get(t or "", -1), i)
        size[t or ""] += 1
    got = {r.doc_id: r for r in exact_groups(docs, keep="max").collect()}
    assert len(got) == 60
    for i, t, *_ in made():
        t = t or ""
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (best[t], size[t], best[t] == i, hashlib.sha256(t.encode()).hexdigest())
    from pyspark.sql import functions as F

    weak = exact_groups(docs, keep="max", digest=lambda c: F.length(c).cast("string").cast("binary"))
    assert sorted(map(tuple, weak.collect())) == sorted(map(tuple, exact_groups(docs, keep="max").collect()))
    assert exact_groups(none).isEmpty()
    assert exact_dedup(docs.union(docs)).count() == len(size)
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, None), (None, "")]
    again = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), keep="max")
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in again.collect()) == [(0, 0, 2, True), (0, 0, 2, True), (1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]


def test_exact_dedup_keeps_other_texts(spark):
    """Another text under the id of a dropped copy, or under none, stays; null and empty text are one text."""
    from sparkloom.llm.exact_dedup import exact_dedup

    rows = [(None, "a"), (None, "b"), (None, "b"), (3, "c"), (5, "c"), (5, "d"), (1, "a"), (7, None), (7, ""), (8, "")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"]
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted([(None, "b"), (3, "c"), (5, "d"), (1, "a"), (7, "")], key=str)


def test_line_dedup(docs, none):
    from sparkloom.llm.line_dedup import line_dedup

    seen, want = set(), {}
    for i, t, *_ in made():
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        want[i] = (len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(docs).collect()}
    assert got == want and line_dedup(none).isEmpty()


def test_pii(docs, none, spark):
    from sparkloom.llm.pii import PATTERNS, pii_report, pii_spans, redacted

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "é😀 x@y.zz", "+1 +2 3456789012", "9" * 30000, "a" * 50000 + "@", "4111111111111111 1", "001.2.3.255", "@@a@b-c.d..e"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    for r in pii_report(table).collect():
        base = [f"{k}:{m.start()}:{m.end()}" for k in ("email", "ip", "card", "phone") for m in re.finditer(PATTERNS[k], texts[r.doc_id]) if ok(k, m[0])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (r, base)
        assert all(x in r.spans.split(",") for x in base)
    assert "iban:" in pii_report(docs).where("doc_id = 14").head().spans
    assert "[email]" in redacted(pii_spans(docs).where("doc_id = 14")).head().text
    assert pii_report(none).isEmpty()


def test_account_numbers_before_capitals(spark):
    """A valid account number is found whatever word follows it."""
    from sparkloom.llm.pii import pii_spans

    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    texts = [f"IBAN {gb} Please pay", f"IBAN {gb} BIC ABCDEFGH", f"IBAN {gb} {de} X", f"pay AB12 {de} NOW", f"{gb}", f"IBAN {gb[:-1]}3 BIC", f"X{de} a", f"{de}x"]
    want = [[gb], [gb], [gb, de], [de], [gb], [], [], []]
    found = pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[r.text[x.start : x.end] for x in r.spans if x.kind == "iban"] for r in sorted(found)] == want


def test_secrets_by_context(spark):
    """Keys and tokens need a word for them nearby; a word against them takes that back, and lowers a valid account number."""
    from sparkloom.llm.pii import pii_report

    key = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    texts = [f'token = "{key}"', f"see {key}", f"commit token {key}", f"password: {key[:19]}", "secret: " + "a" * 40, f"Api-Key {key}-x_1 and token {key[::-1]}", f"token far off, {'word ' * 12}{key}", "a sample DE89370400440532013000", "DE89370400440532013000", "IBAN DE89370400440532013000"]
    got = [(r.n_secret, r.spans, r.scores) for r in sorted(pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())]
    assert got == [(1, "secret:9:49", "0.80"), (0, "", ""), (0, "", ""), (0, "", ""), (0, "", ""), (2, "secret:8:52,secret:63:103", "0.80,0.80"), (0, "", ""), (0, "", ""), (0, "iban:0:22", "0.80"), (0, "iban:5:27", "0.95")]


def test_simhash(docs, none):
    from sparkloom.llm import simhash as m

    def brute(t):
        import xxhash

        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = {i: brute(t) for i, t, *_ in made()}
    assert {r.id: r.fp & (1 << 64) - 1 for r in m.fingerprints(docs).collect()} == fp
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in m.simhash_groups(docs).collect()}
    assert got == {i: (fp[i], c) for i, c in linked(fp).items()}
    assert m.simhash_groups(none).isEmpty()


def linked(fp):
    at = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    at[i] = at[j] = min(at[i], at[j])
    return at


def test_simhash_links_at_all_distances(spark):
    from sparkloom.llm import simhash as m
    from sparkloom.llm.common import components

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = set(base) | {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (1, 2, 3, 3, 4) for _ in range(3)}
    links = m._close(spark.createDataFrame([(m._signed(x),) for x in fps], "fp long"))
    got = {x.node & (1 << 64) - 1: x.component for x in components(links).collect()}
    want = linked({x: x for x in fps})
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert [g for g in groups(want) if len(g) > 1] == groups(got)


def test_components_of_chains(spark):
    from sparkloom.llm.common import components

    e = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 303


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparkloom.llm.packing import pack, patterns

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack(docs).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x, *_ in made()}
    seen, used = Counter(), {}
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in used.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048
    h = {7: 10, 5: 3, 3: 4, 1: 2}
    assert Counter(x for p, c in patterns(h, 10) for x in p for _ in range(c)) == Counter(h)
    assert pack(none).isEmpty()


@pytest.mark.parametrize("text", ["a  b", "a \n b", " a", "a ", "x\n\n y", "don't  stop", "a\t b c", "", " ", "é 😀 z", "<|endoftext|> a", "x<|endoftext|>y", " <|endoftext|>  <|endoftext|><|endoftext|>", "<|endoftext", "a <| endoftext|>"])
def test_tokens_by_word_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparkloom.llm.packing import Tokens

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(Tokens().ids(text), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_mixing(docs, none):
    from sparkloom.llm.mixing import mix_report, mixed_documents, permuted

    got = mix_report(docs, block=16, per_shard=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_report(docs, block=16, per_shard=8).collect()))
    assert len(got) == 60 and all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for i, t, _, s, *_ in made():
        n = len(re.findall("[^\x20\x09-\x0d]+", t or ""))
        assert next(r.size for r in got if r.doc_id == i) == n
        by.setdefault(s, [0, 0, 0.0])[0] += n
        r = next(r for r in got if r.doc_id == i)
        by[s][1] += r.taken
        by[s][2] = r.target
    for size, taken, target in by.values():
        assert abs(taken - target) <= 1 and target <= 2 * size + 1e-9
    assert abs(sum(x[2] for x in by.values()) - 1.5 * sum(x[0] for x in by.values())) < 1e-6
    assert sorted(permuted(np.arange(1000), 1000, 77)) == list(range(1000))
    assert (permuted(permuted(np.arange(1000), 1000, 77), 1000, 77, back=True) == np.arange(1000)).all()
    assert mix_report(none).isEmpty()
    words = sum(len((r.text or "").split()) for r in mixed_documents(docs, block=16).collect())
    assert words == sum(r.taken for r in mix_report(docs, block=16).collect())


def test_mixing_tells_rows_apart(spark):
    """Rows without an id and other texts under one id give the words that are drawn of them, each its own."""
    from sparkloom.llm.mixing import mix, mixed_documents

    text = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, text("a", 50), "x"), (None, text("b", 70), "x"), (None, text("c", 40), None), (1, text("d", 90), "x"), (1, text("e", 30), "x"), (1, text("f", 20), "y"), (2, text("g", 60), "y"), (2, text("g", 60), "y"), (3, None, "x"), (4, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed_documents(d, block=8).collect()
    drawn = mix(d, block=8)[0].collect()
    assert sum(len(r.text.split()) for r in got) == sum(r.words for r in drawn) and all(r.text for r in got)
    of = {}
    for r in drawn:
        of[bytes(r.k)] = of.get(bytes(r.k), 0) + r.words
    assert sorted(of.values()) == sorted(len(r.text.split()) for r in got)
    assert {(r.doc_id, r.source, w[0]) for r in got for w in r.text.split()} == {(i, s, t[0]) for i, t, s in rows if t}


def test_mixing_reports_each_repeated_row(spark, monkeypatch):
    """Rows that repeat id, source and text are rows of their own: none gives more than 2 times its words, and all reach the target."""
    from collections import Counter

    from sparkloom.llm import mixing as m

    monkeypatch.setattr(m, "COPIES", 4)
    rows = [(1, "a b", "s")] * 2 + [(2, " ".join(f"w{k}" for k in range(37)), "s")] * 11 + [(None, "x y z", "t")] * 3 + [(3, None, "s")] * 5 + [(4, "one", None)]
    got = m.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for source in (407 + 4, 9, 1):
        of = [r for r in got if r.source_size == source]
        assert of and abs(sum(r.taken for r in of) - of[0].target) <= 1


def test_sharding(docs, none):
    from sparkloom.llm.sharding import shard

    got = shard(docs, 7).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 7 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    texts = {i: t or "" for i, t, *_ in made()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    assert len({r.shard for r in got if r.doc_id in (4, 5, 17, 30)}) == 1
    assert shard(none, 7).isEmpty()


def test_sharding_of_a_hot_group(spark):
    from sparkloom.llm.sharding import shard

    rows = [(i, "hot" if i < 400 else f"pair {i // 2}" if i < 900 else f"t{i}") for i in range(1200)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    assert set(Counter(r.shard for r in got).values()) == {120}
    of = {r.doc_id: r.shard for r in got}
    assert len({of[i] for i in range(400)}) <= 5
    assert sum(of[i] != of[i + 1] for i in range(400, 900, 2)) <= 12


def test_sharding_of_a_doubled_table(spark):
    """Where every row has a copy no shard has room, and yet nearly all pairs are together."""
    from sparkloom.llm.sharding import cut_edges, shard

    for alone in (0, 20):
        rows = [(i, f"pair {i // 2}" if i >= alone else f"t{i}") for i in range(2000 + alone)]
        sharded = shard(spark.createDataFrame(rows, "doc_id long, text string"), 10)
        got = sharded.collect()
        assert set(Counter(r.shard for r in got).values()) == {200 + alone // 10}
        of = {r.doc_id: r.shard for r in got}
        apart = sum(of[i] != of[i + 1] for i in range(alone, 2000 + alone, 2))
        assert tuple(cut_edges(sharded).head()) == (2000, apart, 1000, apart)
        assert sum(of[i] != of[i + 1] for i in range(alone, 2000 + alone, 2)) <= 9


def test_language_and_toxicity(spark, none):
    from sparkloom.llm import langid, toxicity

    r = random.Random(1)
    vocab = {"en": ["the", "and", "shall", "with", "thing"], "fr": ["le", "être", "aux", "ment", "que"]}
    rows = [(i, " ".join(r.choices(vocab[x], k=20)) + (" idiot" if i % 4 == 0 else ""), x) for i, x in ((i, ["en", "fr"][i % 2 ^ i // 7 % 2]) for i in range(300))]
    d = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 ...", "en"), (902, "", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.predict(d, langid.fit(d)).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows) and {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 for i, x in got.items())
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    marks = {x.doc_id: x for x in toxicity.scores(d, toxicity.fit(d, labels)).collect()}
    assert len(marks) == 303 and sum(marks[i].predicted == (i % 4 == 0) for i, *_ in rows) >= 295
    assert toxicity.scores(d, toxicity.fit(d, labels.limit(0))).where("predicted = 1").isEmpty()
    assert langid.predict(none, langid.fit(none)).isEmpty()


def test_pipeline_removes_toxic_rows_by_their_own_text(spark, tmp_path):
    """A toxic row without an id goes, and a clean one stays under the id of a toxic one."""
    import corpus_pipeline as c

    r = random.Random(1)
    text = lambda bad: " ".join(r.choices(["the", "and", "shall", "with", "thing"], k=20)) + (" idiot" if bad else "")
    rows = [(i, text(i % 4 == 0)) for i in range(300)] + [(None, text(True)), (None, text(False)), (1001, text(True)), (1001, text(False))]
    spark.createDataFrame([(i, i % 4 == 0) for i in range(300)], "doc_id long, bad boolean").selectExpr("doc_id", "0 as quality", "int(bad) as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = c.toxicity(spark, d, str(tmp_path))
    assert got.columns == d.columns
    assert sorted(map(tuple, got.where("doc_id is null or doc_id > 1000").collect()), key=str) == sorted((rows[301], rows[303]), key=str)


def test_quality(docs, none):
    from sparkloom.llm.quality import base_counts, quality

    for t in [x[1] for x in made()] + ["a b c a b c\na b c\n\n|x| $", "#é é\n#é é"]:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        win = Counter(zip(w, w[1:], w[2:]))
        hit = {k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert base_counts(t) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
    a, b = ({r.doc_id: r for r in quality(docs, sent=x).collect()} for x in (10**9, 0))
    assert set(a) == set(range(60))
    for i in a:
        assert a[i].kept == b[i].kept and not (a[i].base_failed and a[i].kept)
        assert (a[i].perplexity is None) == (b[i].perplexity is None) and (a[i].perplexity is None or abs(a[i].perplexity - b[i].perplexity) < 1e-3 * a[i].perplexity)
    assert quality(none).isEmpty()


def test_quality_joined_with_shared_and_null_ids(spark):
    """Rows are scored by their own text on either path, whatever their ids."""
    from sparkloom.llm.quality import quality

    texts = ["alpha beta gamma delta " * 15, "zz##qq " * 60, "one two three four five six " * 12, "alpha beta gamma delta " * 15, ""]
    rows = [(i, t, lang) for i in (None, 1) for t in texts for lang in ("en", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (sorted(((str(r.doc_id), r.n_symbols, r.n_words, r.kept, round(r.perplexity or 0, 3)) for r in quality(d, sent=x).collect())) for x in (10**9, 0))
    assert len(a) == len(rows) and a == b


def test_quality_bands_reject_labelled_junk(spark):
    """Of labelled documents that pass the base rules the bands reject a third of the junk and few clean ones."""
    from sparkloom.llm.quality import quality

    found = quality(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("not base_failed")
    both = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("quality", "kept").collect()
    junk, clean = ([r.kept for r in both if r.quality == q] for q in (0, 1))
    assert junk.count(False) >= len(junk) / 3 and clean.count(False) <= 0.03 * len(clean)


def test_kneser_ney_sums_to_one(docs):
    from pyspark.sql import functions as F

    from sparkloom.llm.quality import UNIT, counted, kneser_ney

    orders = kneser_ney(counted(docs.select(F.lit("x").alias("lang"), "text"), {"x": 1}))
    p, g = orders[0]
    total, back = p.where("key >> 8 = 2").agg(F.sum(F.exp(F.col("p") / UNIT))).head()[0], g.where("key = 2").agg(F.exp(F.first("g") / UNIT)).head()[0]
    assert abs(total + back * (256 - p.where("key >> 8 = 2").count()) / 256 - 1) < 1e-4


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline as c

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cut = c.exact(spark, d, str(tmp_path))
    assert sorted(r.doc_id for r in cut.collect()) == sorted({t or "": i for i, t, *_ in reversed(made())}.values())
    assert c.near(spark, cut, str(tmp_path)).columns == d.columns
    unnamed = spark.createDataFrame([(None, f"text {k} of no id", None, None, 0) for k in (1, 1, 2)], d.schema)
    assert c.near(spark, cut.union(unnamed), str(tmp_path)).where("doc_id is null").count() == 2
    assert not c.run(spark, str(tmp_path)).isEmpty()
