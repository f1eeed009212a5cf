import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import byte_pairs
from strandloom.llm import kernels as K
from strandloom.llm import packing as P
from strandloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_round_trip(documents, tokenizer):
    rows = P.pack(documents, tokenizer_path(), {"ids": F.col("ids"), "crc": F.crc32("ids")}, capacity=256, unit=16).collect()
    docs = {}
    for r in documents.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        docs.setdefault(r["doc_id"], []).append(np.array(ids, "<u4").tobytes())
    by_doc, by_seq = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["crc"] == zlib.crc32(r["ids"])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, texts in docs.items():
        got = sorted(by_doc[doc])
        if len(texts) == 1:
            assert b"".join(x for _, x, _ in got) == texts[0] and {n for _, _, n in got} == {len(texts[0]) // 4}
        else:  # repeated rows: every piece once for each row
            assert sorted(b"".join(x for _, x, _ in got)) == sorted(b"".join(texts))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by_seq) == list(range(len(by_seq)))
    total = sum(n for p in by_seq.values() for _, n in p)
    assert len(by_seq) <= -(-total // 256) * 1.03 + 1


def test_empty_and_clashing_columns(empty, documents):
    assert P.pack(empty, tokenizer_path()).collect() == []
    odd = documents.select("doc_id", "text", F.lit(1).alias("length"), F.lit(2).alias("task"), F.lit(3).alias("ids"))
    assert P.pack(odd, tokenizer_path()).count() == P.pack(documents, tokenizer_path()).count()


def test_word_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(3)
    signs = "abzAZéÉßÿÀ09'’!#_-.²½÷×\u00ad\u00a0Σςœ中\u0301\x1c\t\n  "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["it's don't l'été 'S", "a<|endoftext|>b <|startoftext|>", "a\x1cb", "İI ΟΔΟΣ"]
    texts += ["aaaaaaaaaaaaaa aaa", "", "\u00d7\u00f7", "x" * 5000, "A.B,C;1234 '' 'Tis"]
    ids, n = byte_pairs.load(tokenizer_path()).of_slice(*K.buffers(pa.array(texts)))
    end = np.cumsum(n)
    for t, a, b in zip(texts, end - n, end):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_of_nothing():
    ids, n = byte_pairs.load(tokenizer_path()).of_slice(*K.buffers(pa.array(["", " \n"])))
    assert len(ids) == 0 and n.tolist() == [0, 0]
    assert [len(x) for x in byte_pairs.load(tokenizer_path()).of_slice(np.zeros(0, np.uint8), np.zeros(1, np.int64))] == [0, 0]


def test_best_pattern_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes, price = rng.permutation(np.arange(3, 20))[:4], rng.random(4)

        def best(left):
            return max([0.0, *(p + best(left - s) for s, p in zip(sizes, price) if s <= left)])

        value, pattern = P.best_pattern(sizes, price, 30)
        assert np.isclose(value, best(30)) and pattern @ sizes <= 30 and np.isclose(pattern @ price, value)


def test_linear_program_is_optimal_and_plan_is_whole():
    # 3 + 3 + 4 = 10, 6 + 4 = 10: 30 pieces of 3, 30 of 4 and 15 of 6 fill 30 sequences exactly
    sizes, demand = np.array([6, 4, 3]), np.array([15.0, 30.0, 30.0])
    patterns, x = P.cutting_stock(sizes, demand, 10)
    assert np.isclose(x.sum(), 30) and np.allclose(patterns @ x, demand)
    rng = np.random.default_rng(4)
    for _ in range(10):
        hist = {int(s): int(n) for s, n in zip(rng.permutation(np.arange(1, 65))[:20], rng.integers(1, 400, 20))}
        plan = P.plan(hist, 64)
        used, places = {}, {}
        for s, n in hist.items():
            mine = plan[plan[:, 0] == s]
            for rank in range(n):
                row = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                k = rank - row[1]
                places.setdefault(int(row[3] + k // row[2]), []).append((int(row[4] + k % row[2] * s), s))
            used[s] = n
        rest = sorted(s for s in hist if s != 64)
        least = P.cutting_stock(np.array(rest), np.array([hist[s] for s in rest], float), 64)[1].sum() + hist.get(64, 0)
        for pieces in places.values():
            at = 0
            for offset, s in sorted(pieces):
                assert offset == at
                at += s
            assert at <= 64
        assert least - 1e-6 <= len(places) <= least + len(rest)  # rounding costs less than a sequence a pattern


def test_cut_points():
    for n in range(1, 700):
        c = P.cut_points(n, 256, 16)
        assert sum(c) == n and all(x == 256 or x % 16 == 0 or x < 16 for x in c)
    doc, size = P._cut(np.arange(1, 700), 256, 16)
    assert [size[doc == i].tolist() for i in range(699)] == [P.cut_points(n, 256, 16) for n in range(1, 700)]


def test_pieces_are_numbered_by_length():
    seen = np.zeros(9, np.int64)
    assert P._numbered(np.array([3, 5, 3, 3]), seen).tolist() == [0, 0, 1, 2]
    assert P._numbered(np.array([5, 3, 8]), seen).tolist() == [1, 3, 0]
