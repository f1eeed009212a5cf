import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    again = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def norm(line):
    line = re.sub("[0-9]+", "0", line).strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def frequent(rows, min_docs, per_mille):
    hosts = defaultdict(set)
    for doc, text, host in rows:
        if doc is not None:
            hosts[host].add((doc, text or ""))
    freq = set()
    for host, texts in hosts.items():
        n = defaultdict(int)
        for _, t in texts:
            for k in {norm(x) for x in t.split("\n") if WORD.search(x)}:
                n[k] += 1
        freq |= {(host, k) for k, v in n.items() if v > min_docs and v * 1000 > per_mille * len(texts)}
    return freq


def brute(rows, min_docs, per_mille, min_left):
    freq, out = frequent(rows, min_docs, per_mille), []
    for doc, text, host in rows:
        m = base(text)
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if WORD.search(x) and (host, norm(x)) in freq)
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        out.append((doc, *m, gone, failed, not failed and (m[0] - gone) * 100 >= min_left * m[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs, per_mille, min_left", [(20, 2, 30), (2, 0, 90), (1, 30, 95)])
def test_matches_brute_force(documents, min_docs, per_mille, min_left):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    want = brute(rows, min_docs, per_mille, min_left)
    df = Q.judge(documents, min_docs=min_docs, per_mille=per_mille, min_left=min_left)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words", "base_failed", "kept")) for r in df.collect()), key=str)
    assert got == want
    if min_docs == 2:
        assert any(x[6] for x in want) and {x[8] for x in want} == {True, False}


def test_repeats_digits_and_symbols(spark):
    loop = "a b c d e f g h " * 4
    rows = [(1, loop, "s"), (2, "x|y #1\nx|y #1\n \nx|y #1", "s"), (3, "été über", None)]
    got = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["n_repeat_words"] == 32 and got[1]["base_failed"]
    assert (got[2]["n_symbols"], got[2]["n_dup_lines"]) == (6, 2)
    assert got[3]["word_chars"] == 7


def test_remove_lines(documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    freq = frequent(rows, 2, 0)
    odd = documents.withColumn("host", F.lit("x")).withColumn("line_hash", F.lit(1))
    df = Q.remove_lines(odd, min_docs=2, per_mille=0)
    assert df.columns == odd.columns
    want = [(d, t if d is None or t is None else "\n".join(x for x in t.split("\n") if not (WORD.search(x) and (h, norm(x)) in freq))) for d, t, h in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str) == sorted(want, key=str) and sorted(want, key=str) != sorted(((d, t) for d, t, _ in rows), key=str)


def test_empty(empty):
    assert Q.judge(empty).collect() == [] and Q.remove_lines(empty).collect() == []
