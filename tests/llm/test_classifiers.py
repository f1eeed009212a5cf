import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import langid, quality_gam, toxicity
from strandloom.llm.common import crc_mod, hash_sample

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, words):
    rng = random.Random(11)
    docs, labels = [], []
    insults = ["zonk", "blarg", "frump"]
    for i in range(1, 700):
        w = [rng.choice(words) for _ in range(rng.randint(15, 60))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(insults) + rng.choice(["", "s", "!!"])
        if not good:
            w = [x.upper() + "$$" for x in w]
        docs.append((i, " ".join(w), "aa" if i % 2 else "bb", "s", 1))
        labels.append((i, int(good), int(toxic)))
    docs += [(5000, None, "aa", None, 0), (5001, "", None, None, 0), docs[3]]
    labels += [(None, 1, 1), (3, None, None), labels[7], (99999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS)


def held(df, labels, column):
    x = df.join(labels.filter("toxic IS NOT NULL").distinct(), "doc_id").filter(crc_mod("doc_id", 5) == 0)
    return x.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


def test_toxicity_held_out_and_order(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, "toxic", crc_mod("doc_id", 5) != 0)
    assert len(model.index) < 3000
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and held(got, labels, "toxic") > 0.9  # three quarters are not toxic
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), "toxic", crc_mod("doc_id", 5) != 0)
    assert np.array_equal(model.index, again.index) and np.allclose(model.weight, again.weight)
    odd = toxicity.score(docs.withColumns({"score": F.lit("x"), "label": F.lit(1)}), model)
    assert odd.schema["score"].dataType.typeName() == "double" and odd.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_ftrl_features_by_brute_force(words):
    import pyarrow as pa

    from strandloom.llm import kernels as K

    texts = ["a b c", "", "x", "one two THREE two"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    row, at = toxicity.features(*toxicity._lower(batch))
    # unigrams + bigrams + skip-grams + stems of words longer than each stem
    want = []
    for t in texts:
        w = t.lower().split()
        want.append(len(w) + max(len(w) - 1, 0) + max(len(w) - 2, 0) + sum(len(x) > s for x in w for s in toxicity.STEMS))
    assert np.bincount(row, minlength=4).tolist() == want
    assert K.SLICE_BYTES > 0


def test_without_labels_nothing_is_toxic(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.limit(0), "toxic", F.lit(True))
    assert toxicity.score(docs, model).filter("predicted = 1").isEmpty()


def test_quality_held_out_and_additive(corpus):
    docs, labels = corpus
    model = quality_gam.fit(docs, labels, "quality", crc_mod("doc_id", 5) != 0)
    assert len(model.pairs) == quality_gam.PAIRS
    got = quality_gam.score(docs, model)
    assert got.count() == docs.count() and held(got, labels, "quality") > 0.97
    none = quality_gam.fit(docs, labels.limit(0), "quality", F.lit(True))
    assert {r["score"] for r in quality_gam.score(docs, none).collect()} == {0.5}


def test_quality_measures():
    text = "Ab cd!\nAb cd!\néé 12"
    raw = text.encode()
    m = dict(zip(quality_gam.FEATURES, quality_gam.measures(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]))
    assert np.isclose(m["log_words"], np.log1p(6)) and np.isclose(m["word_length"], 14 / 6)
    assert np.isclose(m["digits"], 2 / 14) and np.isclose(m["upper"], 2 / 8) and np.isclose(m["exclamations"], 2 / 14)
    assert np.isclose(m["repeated_lines"], 1 / 3) and np.isclose(m["lines_ended"], 2 / 3) and np.isclose(m["distinct_words"], 4 / 6)


def test_pair_interaction_is_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    m = quality_gam.boost(x, y)
    assert (0, 2) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9


def test_language_on_own_alphabets(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        letters, lang = [("abcde", "aa"), ("cdefg", "bb"), ("бвгд", "cc")][i % 3]
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(12)), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? ·", "bb"), (1003, "abcd", None), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs, crc_mod("doc_id", 4) != 2)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    own = [got[i]["lang_pred"] == lang for i, _, lang in rows[:600]]
    assert sum(own) > 590
    none = langid.predict(docs, langid.fit(docs.filter("lang IS NULL"), F.lit(True)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_ngrams_by_brute_force():
    import pyarrow as pa

    row, bucket, has = langid.ngrams(pa.array(["Ab1c", "", "?"]))
    # " ab c " has 6 letters-or-separators: 3 one-grams with letters, pairs with a letter, all triples
    assert np.bincount(row, minlength=3).tolist()[0] == 3 + 5 + 4 and has.tolist() == [True, False, False]


def test_hash_sample_stays_below_the_bound(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    n = hash_sample(df, "doc_id", 5_000).count()
    assert 4_000 < n <= 5_000 and hash_sample(df, "doc_id", 20_000).count() == 20_000
