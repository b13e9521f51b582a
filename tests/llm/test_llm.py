"""The operators against brute force, on small fixtures with nulls, repeats, ties, empty tables and clashing columns."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import components, decontaminate, html, kneser_ney, licenses, packing, pfor, quality, simhash, tokens, topk, toxicity, urls

SF = "/root/testdata/sf0.001"
ODD = [(1, "plain words here"), (2, None), (3, ""), (None, "no id"), (5, "a  b \n c\t d"), (5, "a  b \n c\t d"), (6, "x" * 30_000 + " end"), (7, "Ünï cödé 日本語 <|endoftext|> it's"), (8, " lead and trail ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1.0, "z") for i, t in ODD], "doc_id long, text string, score double, fingerprint string")


def encoder(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file(name))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd):
    ids = encoder("word_bpe_49k.json")
    got = pfor.token_documents(spark, odd, tokens.tokenizer_file("word_bpe_49k.json"), 2).orderBy("start").collect()
    want, at = [], 0
    for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        n = ids(t) + [2]
        want.append((i, at, len(n), crc(n)))
        at += len(n)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert pfor.token_documents(spark, odd.limit(0), tokens.tokenizer_file("word_bpe_49k.json"), 2).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint32)
    ids[: n // 50] = 2**32 - 1
    data, starts = pfor.encode_blocks(ids)
    assert (pfor.decode_blocks(data, starts, n) == ids).all()


def test_packing(spark, odd):
    ids = encoder("byte_bpe_50k.json")
    got = packing.pack_documents(odd, tokens.tokenizer_file("byte_bpe_50k.json"), 1).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    for i, t in set(ODD):
        n = ids(t) + [1]
        covered = np.zeros(len(n), int)
        for start, length, c in pieces[i, len(n)]:
            assert c == crc(n[start : start + length])
            covered[start : start + length] += 1
        assert set(covered) == {ODD.count((i, t))}


ODD_WORDS = ["don't", "it's,", "\u0130stanbul", "\u0130,", "e\u0301t\u00e9", "\u01f0.", "na\u00efve;", "\u212bngstr\u00f6m", "x\u0345", "\u4e2d\u6587", "a\u00a0b", "\u00a0b", "b\u00a0", "12,5", "word.", "Word", "WORD!?", "\U0001d400z", "\ufb01n", "\x01", "a\x01b", "<|endoftext|>", "\u1e9e", "\u0587", "\u02bcn", "\u0149", "'s", "\u0370\u2c2f", "\ua7cb.", "\t", "x\ty"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_told_apart_without_separators(name, monkeypatch):
    """Ids are those of the whole text, whatever stands beside a word, with a cache that overflows; words of letters are
    sent to the tokenizer with nothing but a blank between them."""
    tok = tokens.ChunkTokenizer(tokens.tokenizer_file(name), 40)
    rng, sent = np.random.default_rng(2), []
    monkeypatch.setattr(tok, "_encode_apart", lambda words, f=tok._encode_apart: sent.extend(words) or f(words))
    texts = [sep.join(rng.permutation(ODD_WORDS)[: rng.integers(1, 25)]) for sep in (" ", "\n", "  ", " \n") for _ in range(12)] + ["", None, " ", "\n"]
    for a in range(0, len(texts), 4):
        ids, counts = tok.encode(pa.array(texts[a : a + 4]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tok.t.encode(t or "", add_special_tokens=False).ids for t in texts[a : a + 4]]
    assert name.startswith("byte") and not sent or "word." not in sent and "Word" not in sent and "12,5" in sent


def test_words_met_often_stay_in_the_cache():
    """A cache that overflows keeps what was asked for again, and gives the same ids for it."""
    tok = tokens.ChunkTokenizer(tokens.tokenizer_file("byte_bpe_50k.json"), 300)
    common, met, compute = [f"common{i}" for i in range(100)], [], tok.cache.compute
    tok.cache.compute = lambda words: met.extend(words) or compute(words)
    for n in range(20):
        text = " ".join(["begin", *common, *(f"fresh{n}x{i}" for i in range(60))])
        assert tok.encode(pa.array([text]))[0].tolist() == tok.t.encode(text, add_special_tokens=False).ids
    assert all(met.count(" " + w) == 1 for w in common) and len(tok.cache.index) <= 300


def test_a_word_is_encoded_once_whatever_stop_follows_it():
    """A word's stops are words of their own, and ids are those of the whole text, whatever letter stands before a stop."""
    tok, met = tokens.ChunkTokenizer(tokens.tokenizer_file("byte_bpe_50k.json")), []
    compute = tok.cache.compute
    tok.cache.compute = lambda words: met.extend(words) or compute(words)
    stops = ["", ".", ",", "!?", "###", "'s", "'stop", "-b", ".\u00e9", "(1)", "\"", "<|endoftext|>", ".\u00d7."]
    stems = ["word", "\u00e9t\u00e9", "stra\u00dfe", "\u0142\u00f3d\u017a", "x\u0345", "3\u00d7", "\u00f7", "\u01c5", "\u023f", "\u0250", "\u4e2d\u6587", "\ud7a3", "a1", "n\u2070", "\U0001d400", "\u00aa", "'", ""]
    texts = [" ".join(["begin", *(f"{w}{x}" for x in stops for w in stems[a:b] if w + x), "end"]) for a in range(len(stems)) for b in (a + 1, len(stems))]
    texts += ["", None, ".", "a.", "\u00e9.", "a", "a.\t", *(w + x for w in stems for x in stops)]
    for some in (texts, texts[::-1], ["", ""], []):
        ids, counts = tok.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tok.t.encode(t or "", add_special_tokens=False).ids for t in some] or not some and not len(ids)
    for stem in (" word", " \u00e9t\u00e9", " stra\u00dfe", " \u0142\u00f3d\u017a"):
        assert [w for w in met if w.startswith(stem)] == [stem]
    assert len(met) == len(set(met)) and "###" in met


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, [float("nan")] * 6), (303, [None] * 6), (304, [1e12] * 6), (305, [1.0]), (None, [1.0] * 6), (40, rows[40][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and None not in v and all(map(np.isfinite, v))}
    want = []
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(table).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    assert topk.top_k(table.limit(0)).count() == 0


def test_topk_takes_rows_by_tiles(monkeypatch):
    """Groups, copies and repeated ids, wide and short vectors: all as by brute force; what is kept is merged once for all queries, not for each."""
    rng, merge, merges = np.random.default_rng(5), topk.Best.merge, []
    monkeypatch.setattr(topk.Best, "merge", lambda self, *x: merges.append(1) or merge(self, *x))
    middles = rng.integers(-40, 40, (30, 8))
    x = (middles[rng.integers(0, 30, 3000)] + rng.integers(-3, 4, (3000, 8))).astype(float)
    x[7], x[2900], ids = 1e13, -3e9, np.arange(3000)
    ids[500:560], x[500:530], ids[2000:2100] = 500, x[500], 1999
    mine = np.flatnonzero(ids % 5 == 0)
    pivots = topk.choose_pivots(x[np.abs(x).max(1) < 1e6][:400])
    best, far = topk.Best(len(mine), 20), topk.distances(x, pivots)
    for i in range(0, 3000, 1000):
        part = slice(i, i + 1000)
        topk.search(best, ids[mine], x[mine], far[mine], ids[part], x[part], far[part])
    assert len(merges) <= 6
    for n, q in enumerate(mine):
        scores = [topk._exact(v, x[q]) for v in x] if q in (500, 2900) or n % 40 == 0 else None
        if scores:
            want = sorted({(-s, i) for s, i in zip(scores, ids.tolist()) if i != ids[q]})[:20]
            assert list(zip((-best.scores[n]).tolist(), best.ids[n].tolist())) == want


def fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd):
    base = " ".join(f"word{i % 97} other{i * i % 31}" for i in range(900))
    rows = [*ODD, (20, base), (21, base + " tail"), (22, base.replace("word5 ", "word6 ", 1)), (19, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
    least = {g: min(r[0] for r, x in zip(rows, group) if x == g and r[0] is not None) if any(r[0] is not None for r, x in zip(rows, group) if x == g) else None for g in group}
    want = sorted(repr((r[0], f"{f:016x}", least[g])) for r, f, g in zip(rows, fps, group))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert 19 in kept and not {20, 3} & set(kept) and kept.count(5) == 1


def test_golay_keys_meet():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 3000, dtype=np.int64)
    b = a.copy()
    for i in range(3000):
        for bit in rng.choice(64, 1 + i % 3, replace=False):
            b[i] ^= np.int64(np.uint64(1 << int(bit)).astype(np.int64))
    met = set()
    for x, y in ((a, b), (b, a)):
        left, right = (set(zip(*map(list, simhash.golay_keys(f, side)))) for f, side in ((x, True), (y, False)))
        met |= {i for i, k in left if (i, k) in right}
    assert met == set(range(3000))


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**62), 2**62, 60, dtype=np.int64)
    fps = {0, 1, 7, 15, -1, *base.tolist()}
    for x in base.tolist():
        for _ in range(6):
            y = x
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                y ^= int(np.uint64(1 << int(bit)).astype(np.int64))
            fps.add(y)
    got = set(map(tuple, simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()))
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_keep_one_keeps_one_row_of_each_component(spark):
    text, other = " ".join(f"w{i}" for i in range(400)), " ".join(f"v{i}" for i in range(400))
    rows = [(5, text, "a"), (5, other, "b"), (9, text, "c"), (None, text, "d"), (None, other, "e"), (None, "lone", "f"), (None, "lone", "g"), (7, "twice", "h"), (7, "twice", "h")]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n_links string")).collect()]
    assert sorted(kept, key=repr) == sorted([(5, text), (5, other), (None, "lone"), (7, "twice")], key=repr)
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21)] + [(50, i) for i in range(51, 80)]
    got = dict(map(tuple, components.components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got[4] == 1 and got[9] == 7 and got[21] == 20 and all(got[i] == 50 for i in range(50, 80)) and len(got) == 39


def kneser_ney_by_hand(texts, order):
    """Whole logarithms of each symbol's probability, by the textbook's recursion over counts in dictionaries."""
    words = []
    for t in texts:
        ws = (t or "").split()
        words += [kneser_ney.REPEAT if i and ws[i - 1] == w else w for i, w in enumerate(ws)]
    strings = [kneser_ney.BOS * (order - 1) + w + kneser_ney.EOS for w in words]
    raw = {k: Counter(s[i - k + 1 : i + 1] for s in strings for i in range(order - 1, len(s))) for k in range(1, order + 1)}
    lefts = {k: defaultdict(set) for k in range(1, order)}
    for k in range(1, order):
        for g in raw[k + 1]:
            lefts[k][g[1:]].add(g[0])
    count = {k: {g: n if k == order or g[0] == kneser_ney.BOS else len(lefts[k][g]) for g, n in raw[k].items()} for k in raw}
    d = {k: kneser_ney.discounts(*[sum(c == i for c in count[k].values()) for i in (1, 2, 3, 4)]) for k in count}
    base = 1 / (len(count[1]) + 1)

    def p(g):
        k = len(g)
        if not k:
            return base
        after = {x: c for x, c in count[k].items() if x[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total, taken = sum(after.values()), sum(d[k][min(c, 3) - 1] for c in after.values())
        c = after.get(g, 0)
        return (max(c - d[k][min(c, 3) - 1], 0) / total if c else 0) + taken / total * p(g[1:])

    def log(word):
        s = kneser_ney.BOS * (order - 1) + word + kneser_ney.EOS
        return sum(np.log(p(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s)))

    return log


def test_kneser_ney_equals_the_recursion_and_the_joins(spark):
    rng = np.random.default_rng(1)
    texts = ["abra cadabra abra abra", "banana band", None, "", *[" ".join("".join(rng.choice(list("abcd"), rng.integers(1, 7))) for _ in range(30)) for _ in range(8)]]
    m = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), 4)
    words = ["abra", "ban", "zzz", "日本", "dcba", kneser_ney.REPEATED, "a" * 50]
    by_hand, scorer = kneser_ney_by_hand(texts, 4), kneser_ney.Scorer(m.packed().value)
    found = scorer.words(words)
    assert np.allclose(found[:, 0] / kneser_ney.SCALE, [by_hand(kneser_ney.clean(w)) for w in words], atol=1e-4)
    joined = {r.word: (r.lp, r.symbols) for r in kneser_ney.word_scores(m, spark.createDataFrame([(kneser_ney.clean(w),) for w in words], "word string")).collect()}
    assert [tuple(x) for x in found.tolist()] == [joined[kneser_ney.clean(w)] for w in words]
    empty = kneser_ney.train(spark.createDataFrame([(None,)], "text string"), 4)
    assert empty.size() == 0 and kneser_ney.Scorer(empty.packed().value).words(["ab"]).shape == (1, 2)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fitted = quality.QualityClassifier().fit(docs, labels)
    rows = docs.select("doc_id", "lang", "text").union(spark.createDataFrame([(900, None, None), (901, "xx", ""), (902, "en", "the the the \x04 the the"), (903, "de", "a\x02b  c\td "), (None, "fr", "x" * 200_000)], "doc_id long, lang string, text string"))
    a, b = ({r.doc_id: (r.nll, r.symbols) for r in quality.score(rows, fitted.model, most).collect()} for most in (None, 0))
    assert a == b and len(a) == docs.count() + 5  # both ways, to the last bit
    # limits are the quantile of perplexities under the other half's model
    trusted = docs.join(labels.where("quality = 1"), "doc_id").select("lang", "text", (F.xxhash64("doc_id") % 2 == 0).alias("half")).collect()
    out = []
    for half in (True, False):
        log = kneser_ney.Scorer(kneser_ney.train(spark.createDataFrame([(r.text,) for r in trusted if r.half != half], "text string"), quality.ORDER).packed().value)
        for r in (r for r in trusted if r.half == half and (r.text or "").split()):
            ws, codes, _ = kneser_ney.model_words(pa.array([r.text]))
            s = log.words(ws)[codes].sum(axis=0)
            out.append((r.lang, -s[0] / kneser_ney.SCALE, s[1]))
    mean = {k: sum(x[1] for x in out if x[0] == k) / sum(x[2] for x in out if x[0] == k) for k in {x[0] for x in out}}
    for k, limit in fitted.limits.items():
        xs = sorted((n + quality.DRAWN * mean[k]) / (c + quality.DRAWN) for lang, n, c in out if lang == k)
        assert abs(limit - xs[int(np.ceil(quality.UPPER * len(xs))) - 1]) < 1e-9
    keep = {r.doc_id: r.keep for r in fitted.decide(rows).collect()}
    assert not keep[900] and not keep[901] and not keep[902]
    good = quality.quality(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in good.collect()}
    assert kept[1] > 0.95 and kept[0] < 0.3
    own = docs.withColumn("nll", F.lit("x")).withColumn("x", F.lit(1))
    assert quality.keep_good(own, labels).columns == own.columns
    assert quality.quality(docs.limit(0), labels).count() == 0 and quality.quality(docs.limit(9), labels.limit(0)).where("keep").count() == 9


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    pos, neg = held[held.toxic == 1].score, held[held.toxic == 0].score
    assert np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]) > 0.85 and held.score.between(0, 1).all()
    assert toxicity.toxicity(docs.limit(5), labels.limit(0)).where("score = 0 and predicted = 0").count() == 5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    own = docs.limit(40).withColumn("ratio", F.lit("x")).withColumn("score", F.lit(1))
    assert toxicity.drop_toxic(own, labels).columns == own.columns


def toxic_rows():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        words = [f"w{int(x)}" for x in rng.zipf(1.5, 60) % 300]
        if i % 4 == 0:
            for w in rng.choice(["vile", "nasty", "foul"], 3):
                words.insert(int(rng.integers(0, 60)), w)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return [*rows, (200, rows[0][1], 1), (201, None, 0), (202, "", 1), (None, "vile", 1)]


def test_toxicity_by_hand(spark):
    """Counts, kept parts and passages against dictionaries; both ways of scoring to the last bit."""
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    fitted = toxicity.ToxicityClassifier().fit(docs, labels)
    seen = {0: set(), 1: set()}
    for i, t, c in rows:
        if i is not None and t:
            ws = t.lower().split()
            seen[c] |= set(zip([None, *ws], ws))
    n = [Counter(w for _, w in seen[c]) for c in (0, 1)]
    m = [sum(x.values()) for x in n]
    kept, both = [], sum(m)
    for c in (0, 1):
        d = kneser_ney.discounts(*[sum(v == k for v in n[c].values()) for k in (1, 2, 3, 4)])
        far = 1 + toxicity.BEYOND * (both / m[c] - 1)
        kept.append({w: x for w, v in n[c].items() if (x := v - d[min(v, 3) - 1] - far * m[c] * (n[0][w] + n[1][w]) / both) > 0})
    rest = [1 - sum(kept[c].values()) / m[c] for c in (0, 1)]
    p = lambda c, w: kept[c].get(w, 0) / m[c] + rest[c] * (n[0][w] + n[1][w]) / both
    ratio = {w: np.log(p(1, w) / p(0, w)) - np.log(rest[1] / rest[0]) for w in {*kept[0], *kept[1]}}
    assert {"vile", "nasty", "foul"} <= {w for w, x in ratio.items() if x > 0.3}
    texts = [(i, t) for i, t, _ in rows] + [(300, "A VILE, (nasty) one. " + "x " * 90 + "foul"), (301, "foul " * 3000)]
    more = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = ([r.ratio for r in toxicity.features(more, fitted.model, most).orderBy("doc_id", "text").collect()] for most in (None, 0))
    assert a == b

    def by_hand(t):
        vs = [ratio.get(w.strip(".,()"), 0) for w in (t or "").lower().split()]
        at = [i for i, w in enumerate((t or "").lower().split()) if w.strip(".,()") in ratio]
        return max([0.0, *(sum(vs[i : i + toxicity.PASSAGE]) / toxicity.PASSAGE for i in at)])

    assert np.allclose(a, [by_hand(t) for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))], atol=1e-9)


def test_decontamination(spark):
    item = "Alice bought 12 apples for 30 dollars and then gave 12 apples to her friend Bob before the long trip home"
    other = item.replace("12", "17").replace("30", "44").replace("Alice", "Carol")
    broken = item.replace("gave 12", "gave 99").replace("12", "17", 1)
    twice = item.replace("12", "20") + ". Then again: " + item.replace("12", "31") + "."
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Some text first. " + item + " and more."), (2, other), (3, "nothing of it at all here today"), (4, None), (None, item), (5, broken), (6, twice)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 7): True, (2, 7): False, (None, 7): True, (6, 7): False}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


PAGE = '<html><body><nav><a href=x>Menu</a></nav><div class="ad">Buy {i}</div><article><h1>T{i}</h1><p>Body &amp;\n text {i} <b>bold<br>x<p>More {i} words on page number {i} here</article><div>Same line everywhere</div><footer>F {i}</footer>'


def test_html(spark):
    pages = [(i, "http://a.example/p", PAGE.replace("{i}", str(i))) for i in range(6)] + [(20, "http://a.example/q", PAGE.replace("{i}", "3")), (30, None, None), (31, "http://b.example/", "<p>alone</p><script>no</script>")]
    pages += [(40 + i, "http://c.example/", f"<div>Notice to all readers of this site</div><div>Own text number {i} {'w' * (40 + i)}{i}</div>") for i in range(5)]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = "T2\nBody & text 2 bold x\nMore 2 words on page number 2 here"
    assert got[2] == (want, len(want))
    assert got[20][0].startswith("T3") and got[30] == ("", 0) and got[31][0] == "alone"
    assert got[42][0].startswith("Own text number 2") and got[40][0].startswith("Own text number 0")


def test_urls(spark):
    cases = {"http://A.NET/x": ("a.net", "/x", "net/", "block"), "https://m.example.net/en/1#t": ("m.example.net", "/en/1", "example.net/en/", "allow"), "http://x.org/fr/?q": ("x.org", "/fr/", "org/fr/", "allow"), "http://net": ("net", "", None, None), "nothing": ("", "", None, None), "http://example.com/de/a": ("example.com", "/de/a", "example.com/de/", "block")}
    pages = spark.createDataFrame([*enumerate(cases), (90, None)], "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(pages).collect()}
    for i, want in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == want[:3] and r.verdict == (want[3] or r.verdict) and r.verdict in ("allow", "block")
    assert got[90].host == ""


class Markov:
    """Witten-Bell by dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            s = kneser_ney.BOS * urls.ORDER + t + kneser_ney.EOS
            for i in range(urls.ORDER, len(s)):
                for k in range(urls.ORDER + 1):
                    self.counts[s[i - k : i]][s[i]] += 1
        self.base = 1 / (len(self.counts[""]) + 1)

    def p(self, context, c):
        row = self.counts.get(context)
        below = self.p(context[1:], c) if context else self.base
        if not row or context and sum(row.values()) < urls.LEAST:
            return below
        return (row[c] + len(row) * below) / (sum(row.values()) + len(row))

    def log(self, t):
        s = kneser_ney.BOS * urls.ORDER + t + kneser_ney.EOS
        return sum(np.log(self.p(s[i - urls.ORDER : i], s[i])) for i in range(urls.ORDER, len(s)))


def test_url_models_by_hand(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in urls.filter_urls(pages.union(spark.createDataFrame([(9001, None, ""), (9002, "no scheme", None), (9003, "http://é.example/日本?x", None), (9003, "http://é.example/日本?x", None)], pages.schema))).collect()}
    examples = {(r.verdict, r.host + r.path) for r in got.values() if r.rule}
    held = {t: h for t, h in spark.createDataFrame([(t,) for _, t in examples], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(urls.HELD_BACK)) == 0).collect()}
    fit = {v: Markov([t for w, t in examples if w == v and not held[t]]) for v in ("allow", "block")}
    ratio = lambda t: (fit["allow"].log(t) - fit["block"].log(t)) / (len(t) + 1)
    for r in list(got.values())[::7] + [got[9001], got[9003]]:
        assert abs(r.ratio - ratio(r.host + r.path)) < 1e-4
    xs = [(w, ratio(t)) for w, t in examples if held[t]]
    cost = lambda c: sum(x < c for w, x in xs if w == "allow") / sum(w == "allow" for w, _ in xs) + sum(x >= c for w, x in xs if w == "block") / sum(w == "block" for w, _ in xs)
    values = sorted({x for _, x in xs})
    least = min(map(cost, [values[0] - 1, *((a + b) / 2 for a, b in zip(values, values[1:])), values[-1] + 1]))
    limit = max((r.ratio for r in got.values() if not r.rule and r.verdict == "block"), default=values[0]) + 1e-9
    assert {r.verdict for r in got.values() if not r.rule} == {"allow", "block"} and cost(limit) <= least + 0.02
    empty = urls.filter_urls(pages.limit(0))
    assert empty.count() == 0 and urls.calibrate([]) == 0.0
    two = [urls.train(spark.createDataFrame([(t,) for t in x], "t string")) for x in (("abc", "abd"), ("zzz",))]
    rows = spark.createDataFrame([("abc/d",), ("",), ("x" * 99,)], "t string")
    a, b = (sorted(map(tuple, urls.ratios(rows, *two, most).collect())) for most in (None, 0))
    assert a == b


def test_licenses(spark):
    mit = ". ".join(licenses.SENTENCES[k].replace(" ", "\n", 1) for k in ("mit.grant", "mit.notice", "mit.warranty")) + "."
    rows = [(1, "Some text without end\nReleased under the MIT License."), (2, mit), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY-NC 4.0."), (6, "not a license at all")]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (5, "CC-BY-NC-4.0")}


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_license_words():
    known = licenses.dictionary()
    assert all(any(a in s for a in licenses.HELD) for s, i in known.items() if not i.startswith("spdx."))
    for _, ids in licenses.RULES:
        assert any(any(a in s for a in licenses.ANCHORS) for s, i in known.items() if i in ids and not i.startswith("spdx."))


def test_license_notices_as_they_stand(spark):
    paragraphs = GPL.split("\n\n")
    rows = [(1, GPL), (2, "\n\n".join(paragraphs[:2])), (3, paragraphs[0].replace("\n", " ")), (4, APACHE), (5, APACHE.replace("\n", " "))]
    rows += [(100 + n, f"// SPDX-License-Identifier: {name}\nint x;") for n, name in enumerate(licenses.NAMES)]
    rows += [(1000 + n, "Preface.\n\n" + ".\n".join(licenses.SENTENCES[i] for i in ids) + ".\n\nEnd.") for n, (_, ids) in enumerate(licenses.TEXTS) if all(i in licenses.SENTENCES for i in ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in licenses.scan(docs).collect():
        got[r.doc_id].add((r.license, r.rule))
    free = ">gpl.free.1>gpl.free.2>"
    assert [got[i] for i in (1, 2, 3)] == [{("GPL-3.0", free + "gpl.hope>gpl.copy>")}, {("GPL-3.0", free + "gpl.hope>")}, {("GPL-3.0", free)}]
    assert got[4] == {("Apache-2.0", ">notice.Apache-2.0>apache.may>apache.copy>apache.basis>")} and got[5] == {("Apache-2.0", ">notice.Apache-2.0>apache.may>")}
    assert [got[100 + n] for n in range(len(licenses.NAMES))] == [{(name, f">spdx>spdx.{name}>")} for name in licenses.NAMES]
    for n, (name, ids) in enumerate(licenses.TEXTS):
        if all(i in licenses.SENTENCES for i in ids):
            assert got[1000 + n] == {(name, f">{'>'.join(licenses.RULES[n][1])}>")}, ids
    import duckdb

    with duckdb.connect() as c:
        c.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
        assert {(i, n, r) for i, n, r in c.execute(licenses.oracle()).fetchall()} == {(i, *x) for i, v in got.items() for x in v}


def test_decontamination_of_other_names_numbers_and_units(spark):
    tom = "Tom has 12 apples. Tom gives 5 apples to his friend Ann. Tom then buys 7 more apples at the market. How many apples does Tom have now?"
    starts = "Mary picked 9 ripe plums before lunch. Mary ate 2 of the ripe plums in the garden. How many ripe plums were left over?"
    train = "A train travels 60 kilometers in the first 2 hours and then 90 kilometers in the next 3 hours. How many kilometers does it travel in all?"
    bench = spark.createDataFrame([(1, tom), (2, starts), (3, train), (4, "the quick brown"), (5, "Photosynthesis")], "item_id long, text string")
    docs = {
        10: tom.replace("Tom", "Sam"), 11: tom.replace("12", "twenty").replace("5", "three"), 12: "Intro here. " + tom.replace("Tom", "Sam").replace("12", "Twenty-one") + " More follows.",
        13: starts.replace("Mary", "Peter"), 14: "Well, " + starts, 15: train.replace("kilometers", "miles"), 16: "Once the quick brown fox ran over the hill.", 17: "quick brown", 18: "It is called photosynthesis by people.",
        20: "Tom has a house. Tom walks home with his friend Ann. Tom then sleeps until noon. How long does Tom sleep?", 21: tom.replace("Tom gives", "Sam gives").replace("Tom then", "Joe then").replace("does Tom", "does Kim").replace("5", "8").replace("12", "9").replace("apples at", "plums at").replace("friend", "old aunt"),
    }
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()}
    assert got == {(10, 1, False), (11, 1, False), (12, 1, False), (13, 2, False), (14, 2, True), (15, 3, False), (16, 4, True), (18, 5, True)}


def naive_match(a, b):
    """Simple tree matching by its definition."""
    if a.tag != b.tag or a.mark != b.mark:
        return 0
    xs, ys = a.children, b.children
    m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + naive_match(x, y))
    return 1 + m[-1][-1]


def test_tree_matching_by_definition():
    rng = np.random.default_rng(2)

    def grow(depth=0):
        if depth > 3 or rng.random() < 0.2:
            return f"t{rng.integers(0, 3)}"
        tag = ["div", "p", "section", "ul"][rng.integers(0, 4)]
        return f"<{tag}{' class=ad' if rng.random() < 0.1 else ''}>" + "".join(grow(depth + 1) for _ in range(rng.integers(0, 5))) + f"</{tag}>"

    for _ in range(150):
        a, b = (html.parse("<body>" + "".join(grow() for _ in range(4)) + "</body>") for _ in range(2))
        shapes = html.Shapes()
        shapes.number(a)
        shapes.number(b)
        assert shapes.weight(a.shape, b.shape) == naive_match(a, b)
        order = {id(leaf): i for i, (leaf, _, _) in enumerate(html.leaves(b))}
        found = html.tree_match(a, b, shapes)
        at = [order[id(found[id(leaf)])] for leaf, _, _ in html.leaves(a) if id(leaf) in found]
        assert at == sorted(set(at))  # each leaf once, in order


def test_html_long_and_marked_pages(spark):
    import time

    kept = "<article><div class='entry-header'><h1>Title</h1></div><p>Body one</p><p class='legal-analysis'>Body two</p><div class='comments'>No</div></article>"
    story = "<div class='header-image-post'><p>Whole story here</p></div><div class='site-header'>No</div>"
    flat = lambda i: "<body><p>Same notice</p>" + "".join(f"<p>Own {i} {k}</p>" for k in range(3000)) + "</body>"
    shared = "Boilerplate that all pages of this host share, " * 6
    one = lambda i: f"<body><div>{shared}</div><div>Own words {i}</div><div>Last line</div></body>"
    rows = [(1, "http://x.example/", kept), (2, "http://y.example/", story), (3, "http://z.example/", "<div class='banner'>All there is</div>"), (5, None, "<p>x</p>"), (5, None, None)]
    rows += [(10 + i, "http://flat.example/", flat(i)) for i in range(3)] + [(20 + i, "http://share.example/", one(i)) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("z"))
    began = time.time()
    found = html.extract(pages).collect()
    assert time.time() - began < 60
    got = {r.page_id: r.text for r in found if r.page_id != 5}
    assert got[1] == "Title\nBody one\nBody two" and got[2] == "Whole story here" and got[3] == "All there is"
    assert all(got[10 + i] == "\n".join(f"Own {i} {k}" for k in range(3000)) for i in range(3))
    assert all(got[20 + i] == f"Own words {i}" for i in range(8)) and sorted(r.text for r in found if r.page_id == 5) == ["", "x"]
    assert sorted(r.text for r in html.extract(pages, 0).collect()) == sorted(r.text for r in found)
    assert sum(r.wrapped for r in found) == 11 and html.extract(pages.limit(0)).count() == 0


def test_html_layouts_notices_and_depth(spark):
    own = lambda i: f"Own text of page {i}: " + " ".join(f"w{i}x{k}" for k in range(20))
    one = lambda i: f"<body><div>Notice of layout one to all readers</div><div>{own(i)}</div></body>"
    two = lambda i: f"<body><section><p>Notice of layout two to all readers</p><p>{own(i)}</p></section></body>"
    turning = lambda i: f"<body><div>Advert number {i % 3} for you</div><div>{own(i)}</div></body>"
    deep = lambda i: "<div>" * 70 + f"<p>Notice far below to all readers</p><p>{own(i)}</p>" + "</div>" * 70
    pages = [(0, "http://a.example/", "")] + [(i, "http://a.example/", one(i)) for i in range(1, 6)]
    pages += [(i, "http://b.example/", (one if i < 16 else two)(i)) for i in range(10, 21)]
    pages += [(i, "http://c.example/", turning(i)) for i in range(30, 42)] + [(i, "http://d.example/", deep(i)) for i in range(50, 56)]
    copies = [(i, "http://e.example/", one(60 + i % 3)) for i in range(60, 69)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages + copies, "page_id long, url string, html string")).collect()}
    assert got[0] == "" and {i: got[i] for i, _, t in pages if t} == {i: own(i) for i, _, t in pages if t}
    assert all(own(60 + i % 3) in got[i] for i in range(60, 69))


def test_step_groups_are_balanced_by_tier(spark):
    # each partition makes a few sequences of each tier
    text = " ".join(f"word{i}" for i in range(20_000))
    rows = [(i, text[: 70_000 + 300 * (i % 7)] if i % 2 else text[: 2_000 + 10 * i]) for i in range(64)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 32), "doc_id long, text string")
    sequences = {(r.sequence_id, r.tier, r.step_group) for r in packing.pack_documents(docs, tokens.tokenizer_file("byte_bpe_50k.json"), 1).collect()}
    count = defaultdict(lambda: [0] * packing.STEP_GROUPS)
    for _, tier, group in sequences:
        count[tier][group] += 1
    assert len(sequences) == len({s for s, _, _ in sequences})
    assert count[2048] and set(count) & {256, 512, 1024}
    for tier, found in count.items():  # a partition's last ids make one sequence of a shorter size at most, unbalanced
        assert tier not in packing.TIERS or max(found) - min(found) <= 0.3 * sum(found) / packing.STEP_GROUPS + 2, (tier, found)


def test_pipeline_stages_by_their_definitions(spark, tmp_path):
    """Each stage of a run over a small folder, with nulls, empty texts, repeats and copies, against its definition."""
    import re

    import corpus_pipeline
    from folioframe.llm import common

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.where("doc_id = 1").first()
    more = [(5000, None), (5001, ""), (None, one.text), (5002, one.text), (5002, one.text), (5003, one.text + " end")]
    docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    steps, frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")], []
    before = len(common.SCRATCH)
    for _, stage in corpus_pipeline.STAGES:
        frames.append(common.materialize(stage(spark, steps[-1], str(tmp_path)), "test"))
        steps.append(frames[-1])
    rows = [[(r.doc_id, r.text) for r in s.collect()] for s in steps[:-1]]
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    keep = {(r.doc_id, r.keep) for r in quality.quality(steps[0], labels).collect()}
    assert Counter(i for i, _ in rows[1]) == Counter(i for i, _ in rows[0] if (i, True) in keep)
    curve = toxicity.ToxicityClassifier().fit(steps[1], labels)
    assert Counter(rows[2]) == Counter((r.doc_id, r.text) for r in curve.score(steps[1]).collect() if r.score < toxicity.THRESHOLD)
    fps = [fingerprint(t) for _, t in rows[2]]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, t), f, g in zip(rows[2], fps, group):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, _ in rows[3]) == sorted(least.values())
    norm = lambda x: " ".join(re.findall(r"\w+", (x or "").lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    held = [any(x and x in norm(t) for x in items) for _, t in rows[3]]
    assert not {i for (i, _), h in zip(rows[3], held) if h} & {i for i, _ in rows[4]}
    assert len(rows[4]) >= 0.98 * (len(rows[3]) - sum(held)) and all(s.columns == steps[0].columns for s in steps[1:-1])
    ids = encoder("byte_bpe_50k.json")
    pieces = Counter()
    for r in frames[-1].collect():
        pieces[r.doc_id] += r.length
    assert pieces == Counter({i: len(ids(t)) + 1 for i, t in rows[4]})
    common.delete_scratch(spark, [], before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and len(common.SCRATCH) <= before + 1


def test_all_labels_are_taken(spark, monkeypatch):
    """More labels than are broadcast at a time: each document with a label, once."""
    from folioframe.llm import common, labelled

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.union(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))
    want = sorted((r.doc_id, r.text, r.toxic) for r in docs.join(labels.dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect())
    monkeypatch.setattr(labelled, "MOST_LABELS", max(2, len(want) // 3))
    rows = labelled.labelled(docs, labels, "toxic")
    assert sorted((r.doc_id, r.text, r.label) for r in rows.collect()) == want
    common.release(rows)
    assert not any("labelled-" in path or "labels-" in path for path in common.SCRATCH)


def test_quantiles_from_counts(spark):
    from folioframe.llm.labelled import quantiles

    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=9000), "b": np.round(rng.exponential(size=5000), 1), "c": np.array([2.5]), "d": np.array([1e-300, 1.0, 1e300] * 7), "e": np.nextafter(1, [0, 1, 2])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, x double")
    for q in (0.001, 0.5, 0.999, 1.0):
        assert quantiles(rows, "k", "x", q) == {k: float(np.sort(v)[int(np.ceil(len(v) * q)) - 1]) for k, v in values.items()}
    assert quantiles(rows.limit(0), "k", "x", 0.5) == {}


def test_packing_in_small_chunks(spark, odd):
    """Chunks and kept words set memory, not the result."""
    file = tokens.tokenizer_file("byte_bpe_50k.json")
    a, b = (sorted(repr(r) for r in packing.pack_documents(odd.coalesce(1), file, 1, **x).collect()) for x in ({}, {"chunk": 50, "words": 20}))
    assert a == b
