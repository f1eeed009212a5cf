"""Scores of the learned operators against plain versions, one document and one number at a time; edge cases of tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import kernels as K
from strandloom.llm import langid, near_dup, packing, quality_gam, quality_rules, toxicity, url_filter
from strandloom.llm.common import crc_mod
from strandloom.llm.queries import tokenizer_path

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(i, rng.randrange(2), int(i % 4 == 0)) for i in range(150)], LABELS)


def hash_of(raw):
    return int(K.span_hash(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])


def mix(x):
    return int(K.mix64(np.array([x % 2**64], np.uint64))[0])


def plain_features(text):
    """Indices of words, neighbours, skip-grams and stems."""
    kind = [mix(i) for i in range(16)]
    w = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").lower().encode())
    h = [hash_of(x) for x in w]
    keys = [x ^ kind[0] for x in h]
    for k, gap in ((1, 1), (2, 2)):
        keys += [(a * 3 + mix(b)) % 2**64 ^ kind[k] for a, b in zip(h, h[gap:])]
    for k, size in enumerate(toxicity.STEMS, 3):
        keys += [hash_of(x[:size]) ^ kind[k] for x in w if len(x) > size]
    return {mix(k) >> (64 - toxicity.BITS) for k in keys}


def test_toxicity_by_plain_ftrl(spark, documents, labels):
    docs = documents.filter("doc_id < 150 AND doc_id <> 3 AND doc_id <> 140")
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    order = [r["doc_id"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()]
    sets = {d: sorted(plain_features(text[d])) + [-1] for d in order}
    p = sum(label[d] for d in order) / len(order)
    prior = math.log(p / (1 - p))
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for d in order:
            w = {i: weight(i) for i in sets[d]}
            g = 1 / (1 + math.exp(-(sum(w.values()) + prior))) - label[d]
            for i in sets[d]:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if i >= 0 and weight(i)}
    assert set(model.index.tolist()) == set(want) and np.allclose(model.weight, [want[i] for i in model.index.tolist()], atol=1e-9)
    assert math.isclose(model.bias, prior + weight(-1), abs_tol=1e-9)
    for r in toxicity.score(documents, model).collect():
        total = sum(want.get(i, 0.0) for i in plain_features(r["text"])) + model.bias
        assert math.isclose(r["score"], 1 / (1 + math.exp(-total)), abs_tol=1e-9) and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_bound_in_bytes(spark, documents, labels):
    few = toxicity.fit(documents, labels, "toxic", F.lit(True), max_train_bytes=20_000)
    none = toxicity.fit(documents.limit(0), labels, "toxic", F.lit(True))
    assert len(few.index) <= len(toxicity.fit(documents, labels, "toxic", F.lit(True)).index) and none.bias == -20


def test_quality_by_plain_lookup(documents, labels):
    model = quality_gam.fit(documents, labels, "quality", crc_mod("doc_id", 5) != 0)
    for r in quality_gam.score(documents, model).collect():
        raw = (r["text"] or "").encode()
        x = quality_gam.measures(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        total = model.bias + sum(t[sum(v >= c for c in cut)] for v, cut, t in zip(x, model.cuts, model.tables))
        total += sum(g[sum(x[i] >= c for c in model.coarse[i]), sum(x[j] >= c for c in model.coarse[j])] for (i, j), g in zip(model.pairs, model.grids))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-total)), abs_tol=1e-9) and r["predicted"] == int(r["score"] >= 0.3)


def test_one_boosting_step_by_brute_force():
    """The best tree of three leaves is the best of its two greedy cuts, each found by trying all."""
    rng = np.random.default_rng(8)
    for _ in range(50):
        n = int(rng.integers(2, 9))
        g, h = rng.normal(size=n), rng.random(n) + 0.1

        def value(edges):
            return sum(g[a:b].sum() ** 2 / (h[a:b].sum() + quality_gam.RIDGE) for a, b in zip(edges, edges[1:]))

        edges = [0, n]
        for _ in range(2):
            best = max(([*sorted({*edges, c})] for c in range(1, n) if c not in edges), key=value, default=edges)
            edges = best if value(best) > value(edges) + 1e-12 else edges
        table = quality_gam._three_leaves(g, h)
        for a, b in zip(edges, edges[1:]):
            assert np.allclose(table[a:b], g[a:b].sum() / (h[a:b].sum() + quality_gam.RIDGE))


def plain_buckets(text):
    s = " " + re.sub(r"[^\W\d_]+", lambda m: m[0], re.sub(r"(?:[\W\d_])+", " ", (text or "").lower())) + " "
    cp, out = [ord(c) for c in s], []
    for n in range(langid.ORDER):
        for i in range(len(cp) - n):
            gram = cp[i : i + n + 1]
            if n < 2 and all(c == 32 for c in gram):
                continue
            h = 0
            for j, c in enumerate(gram):
                h = (h + c * int(langid._MIX[j])) % 2**32 * 0x27D4EB2F % 2**32 ^ j
            h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
            out.append(h >> (32 - langid.BITS))
    return out


def test_language_by_plain_bayes(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(3)) for _ in range(6)), lang) for i in range(90) for a, lang in [[("abcé", "aa"), ("cdeü", "bb"), ("жбв", "cc")][i % 3]]]
    rows += [(100, "X1 y!", "aa"), (101, None, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    counts = {k: Counter() for k in model.langs}
    for _, t, k in rows:
        counts[k].update(plain_buckets(t))
    size = 1 << langid.BITS
    logp = {k: (lambda c, total: lambda b: math.log((c[b] + langid.SMOOTHING) / total))(c, sum(c.values()) + size * langid.SMOOTHING) for k, c in counts.items()}
    prior = Counter(k for _, _, k in rows)
    for r in langid.predict(docs, model).collect():
        b = plain_buckets(r["text"])
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        total = {k: sum(logp[k](x) for x in b) + math.log(prior[k] / len(rows)) for k in model.langs}
        best = max(total, key=lambda k: (total[k], -ord(k[0])))
        assert r["lang_pred"] == best and math.isclose(r["score"], 1 / sum(math.exp(v - total[best]) for v in total.values()), abs_tol=1e-6)


def test_url_statistics_and_trees_by_brute_force(spark):
    rng = random.Random(3)
    urls = [f"http://{rng.choice('ab')}.{rng.choice(['x.net', 'y.org', 'z.com'])}/{rng.choice(['en', 'fr', 'de'])}/{i}" for i in range(200)] + ["", "http://q"]
    df = url_filter.apply_rules(url_filter.split_url(spark.createDataFrame([(u,) for u in urls], "url string")))
    marked = df.withColumn("__label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)).withColumn("fold", url_filter._fold("url"))
    rows = marked.collect()
    stats = {(r["kind"], r["key"]): r for r in url_filter.suffix_stats(marked).collect()}
    suffix = lambda r: ".".join(r["host"].split(".")[-2:])
    for key in {suffix(r) for r in rows}:
        mine = [r for r in rows if suffix(r) == key]
        got = stats["suffix", key]
        assert math.isclose(got["log_count"], math.log1p(len(mine)))
        for fold, rate in [(None, got["rate"]), *enumerate(got["fold_rate"])]:
            own = [r["__label"] for r in mine if r["__label"] is not None and r["fold"] != fold]
            assert math.isclose(rate, (sum(own) + 1) / (len(own) + 2))
    model = url_filter.fit(marked.select("url", "host", "path", "__label"))
    by_join = url_filter.lexical(marked, "url", model.stats, sent=False).select("url", "__x").collect()
    assert Counter(map(str, by_join)) == Counter(map(str, url_filter.lexical(marked, "url", model.stats).select("url", "__x").collect()))

    def walk(tree, bins):
        return tree if not isinstance(tree, tuple) else walk(tree[2] if bins[tree[0]] <= tree[1] else tree[3], bins)

    x = {r["url"]: r["__x"] for r in by_join}
    for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string")).collect():
        bins = [sum(v > c for c in cut) for v, cut in zip(x[r["url"]], model.cuts)]
        margin = model.bias + sum(walk(t, bins) for t in model.trees)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-margin)), abs_tol=1e-9)


def test_empty_tables_and_clashing_columns(spark, documents, empty, labels):
    everything = F.lit(True)
    odd = documents.withColumns({c: F.lit("x") for c in ("score", "predicted", "lang_pred", "label", "host", "n", "bands", "class_id", "line_hash", "__best", "rep")})
    tox, gam, lang = toxicity.fit(odd, labels, "toxic", everything), quality_gam.fit(odd, labels, "quality", everything), langid.fit(odd, everything)
    for made, op in ((tox, toxicity.score), (gam, quality_gam.score), (lang, langid.predict)):
        assert op(empty, made).collect() == []
        plain = {(r["doc_id"], r["text"]): r["score"] for r in op(documents, made).collect()}
        assert {(r["doc_id"], r["text"]): r["score"] for r in op(odd, made).collect()} == plain
    for op, none in ((toxicity.score, toxicity.fit(empty, labels, "toxic", everything)), (quality_gam.score, quality_gam.fit(empty, labels, "quality", everything)), (langid.predict, langid.fit(empty, everything))):
        assert op(documents, none).count() == documents.count()
    assert near_dup.classes(odd).count() == near_dup.classes(documents).count()
    assert quality_rules.judge(odd).count() == documents.count()
    assert packing.pack(empty, tokenizer_path()).collect() == []
    assert pa.__version__
