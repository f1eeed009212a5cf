import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import kernels as K
from strandloom.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_chars, min_docs):
    held = defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held.get(key(x), ())) < min_docs or doc == max(held[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=str)


def test_matches_brute_force_with_and_without_filters(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = brute(rows, 20, 3)
    assert any(n for _, _, n, _ in want)
    assert got(L.dedup_lines(documents, 20, 3)) == want
    assert got(L.dedup_lines(documents, 20, 3, max_filter_bytes=0)) == want
    index = L.LineIndex.of(documents, 20, 3)
    assert got(L.apply_index(documents, index, max_sent_bytes=0)) == want


def held_keys(index):
    """What the filters answer for the frequent keys, and how many fingerprints they hold."""
    blobs = {r["shard"]: L.CuckooFilter.load(bytes(r["filter"])) for r in index.filters.collect()}
    keys = index.frequent().select(L._shard(index.shards).alias("shard"), "lo").collect()
    found = [bool(blobs[r["shard"]].probe(np.array([r["lo"]], np.int64).view(np.uint64))[0]) for r in keys]
    return all(found), len(found), sum(int((f.table != 0).sum()) for f in blobs.values())


def test_filters_follow_insertions_and_deletions(documents, spark, tmp_path):
    a, b = documents.filter("doc_id < 130"), documents.filter("doc_id >= 130")
    start = L.LineIndex.of(a, 20, 3).with_filters(shard_keys=8)
    assert start.shards > 1
    ok, n, stored = held_keys(start)
    assert ok and n == stored > 0
    after = start.insert(b)
    ok, more, stored = held_keys(after)
    assert ok and more == stored > n
    back = after.delete(b.select("doc_id"))
    assert held_keys(back) == (True, n, n)
    after.save(str(tmp_path / "index"))
    again = L.LineIndex.load(spark, str(tmp_path / "index"))
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got(L.apply_index(documents, again)) == got(L.apply_index(documents, again, max_filter_bytes=0)) == brute(rows, 20, 3)
    assert held_keys(again.delete(documents.select("doc_id")))[1:] == (0, 0)


def test_a_hot_shard_is_probed_in_parts(documents):
    index = L.LineIndex.of(documents, 20, 3).with_filters()
    refs = L.probe_by_shard(index.refs, index.filters, index.shards, group_rows=7)
    keys = {(r["hi"], r["lo"]) for r in index.frequent().collect()}
    held = [(r["hi"], r["lo"], r["doc_id"]) for r in index.refs.collect() if (r["hi"], r["lo"]) in keys]
    assert not set(held) - {tuple(r) for r in refs.collect()}


def test_insert_and_delete_are_reversible(documents):
    a, b = documents.filter("doc_id < 100"), documents.filter("doc_id >= 100")
    start = L.LineIndex.of(a, 20, 3)
    after = start.insert(b)
    whole = {tuple(r) for r in L.LineIndex.of(documents, 20, 3).frequent().collect()}
    assert {tuple(r) for r in after.frequent().collect()} == whole
    assert {tuple(r) for r in after.insert(b).frequent().collect()} == whole  # again: nothing changes
    back = after.delete(b.select("doc_id"))
    assert {tuple(r) for r in back.frequent().collect()} == {tuple(r) for r in start.frequent().collect()}


def test_empty_and_clashing_columns(documents, empty):
    assert got(L.dedup_lines(empty)) == []
    odd = documents.withColumns({"hi": F.lit(1), "n_lines": F.lit("x"), "last_doc": F.lit(2), "shard": F.lit(3)})
    df = L.dedup_lines(odd, 20, 3)
    assert got(df) == got(L.dedup_lines(documents, 20, 3)) and {"hi", "last_doc", "shard"} <= set(df.columns)


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    f = L.CuckooFilter.build(keys)
    assert f.probe(keys).all()
    assert L.CuckooFilter.load(f.dump()).probe(keys).all()
    other = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert f.probe(other).mean() < 0.002
    g = L.CuckooFilter(100)
    few = [int(k) for k in keys[:80]]
    assert all(g.insert(k) for k in few)
    assert all(g.delete(k) for k in few[:40]) and g.probe(np.array(few[40:], np.uint64)).all()
    assert g.probe(np.array(few[:40], np.uint64)).mean() < 0.1


def test_line_kernel_matches_split():
    rng = random.Random(1)
    texts = ["".join(rng.choice("a \n\té") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "\n", "\n\n", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    start, end, row = K.lines(data, off)
    raw = data.tobytes()
    lines = [[] for _ in texts]
    s, e = K.strip(data, start, end)
    for a, b, r, x, y in zip(start, end, row, s, e):
        lines[r].append((raw[a:b].decode(), raw[x:y].decode()))
    assert lines == [[(x, x.strip(WS)) for x in t.split("\n")] for t in texts]
    w = K.words(data, off)
    found = [[] for _ in texts]
    for a, b, r in zip(w.start, w.end, w.row):
        found[r].append(raw[a:b].decode())
    assert found == [t.split() for t in texts]
    same = {}
    for a, b, h in zip(w.start, w.end, w.hash):
        assert same.setdefault(raw[a:b], h) == h
    assert len(set(same.values())) == len(same)


def test_digests_of_related_texts_differ():
    """Thue-Morse texts and their complements, which polynomial hashes modulo 2**64 confuse, and texts that differ in zeros or order."""
    pairs = []
    for bits in range(3, 14):
        bit = [bin(i).count("1") % 2 for i in range(1 << bits)]
        for a, b in (("a", "b"), ("ab", "ba"), ("abcdefgh", "hgfedcba")):
            pairs.append(("".join((a, b)[x] for x in bit), "".join((b, a)[x] for x in bit)))
    texts = [x for p in pairs for x in p] + ["", "\0", "\0" * 8, "\0" * 9, "abcdefgh" * 2 + "x" * 8, "abcdefgh" + "x" * 8 + "abcdefgh"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    for which in (0, 1):
        h = K.span_hash(data, end - [len(t) for t in texts], end, which)[0]
        assert len(set(h.tolist())) == len(set(texts))
    alone = [int(K.span_hash(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in texts]
    assert alone == K.span_hash(data, end - [len(t) for t in texts], end).tolist()  # whatever surrounds it
