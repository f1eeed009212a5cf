"""The pipeline against a plain version of each stage, each judged on its own input."""

import random
import zlib

import numpy as np
import pytest
from test_decontaminate import brute as overlaps
from test_line_dedup import brute as clean_lines
from test_near_dup import brute as near_classes

import corpus_pipeline as P
from strandloom.llm import toxicity
from strandloom.llm.queries import tokenizer_path
from strandloom.llm.common import crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, words, tmp_path_factory):
    rng = random.Random(21)
    d = str(tmp_path_factory.mktemp("sf"))
    bench = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(6)]
    docs, labels = [], []
    line = "A long line that many of the documents hold at their end"
    for i in range(260):
        w = [rng.choice(words) for _ in range(rng.randint(12, 60))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "blargson"
        if i % 13 == 1:
            at = rng.randrange(len(w))
            w[at:at] = bench[i % 6][1].split()
        text = " ".join(w)
        if i % 9 == 2:
            text += "\n" + line
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    for i in range(260, 290):
        text = docs[i - 255][1] if i % 2 else docs[i - 255][1].replace(" ", " extra ", 1)
        docs.append((i, text, "en", "s0", len(text)))
    docs += [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_match_a_plain_version(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = step("toxicity", docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), "toxic", crc_mod("doc_id", 5) != 0)
    w = model.dense()

    def toxic(text):
        raw = (text or "").lower().encode()
        at = set(toxicity.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1].tolist())
        return sum(w[i] for i in at) + model.bias >= 0

    want = sorted([x for x in rows(docs) if not toxic(x[1])], key=str)
    assert rows(one) == want and 40 < len(rows(docs)) - len(want) < 90
    two = step("line_dedup", one)
    want = sorted([(d, t) for d, _, _, t in clean_lines(rows(one), 40, 5)], key=str)
    assert rows(two) == want and want != sorted([(d, t or "") for d, t in rows(one)], key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = step("near_dedup", two)
    classes = near_classes(rows(two))
    assert rows(three) == [x for x in rows(two) if classes[x[0]] == x[0]] and three.count() < two.count()
    four = step("decontamination", three)
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(four) == [x for x in rows(three) if not any(overlaps(x[1], b) for b in bench)] and four.count() < three.count()
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    five = step("packing", four).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    left = {}
    for r in five:
        left.setdefault(r["doc_id"], []).append(r)
    for doc, text in rows(four):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(left.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not left


def test_run_gives_the_last_stage(spark, sf):
    got = P.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 100
