import random

import numpy as np

from strandloom.llm import chunk_dedup as C


def chunk_texts(text, reach=C.REACH):
    raw = text.encode()
    s, e, _ = C.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), reach)
    return [raw[a:b] for a, b in zip(s, e)]


def test_chunks_by_brute_force():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh é\n") for _ in range(3000))
    raw = text.encode()
    h = []
    for i in range(len(raw)):
        h.append(sum(int(C._GEAR[raw[i - j]]) << j for j in range(min(16, i + 1))) % 2**32)
    ends = []
    for i in range(C.REACH + 16, len(raw) - C.REACH - 16):
        if all(h[i] < h[j] for j in range(i - C.REACH, i + C.REACH + 1) if j != i) and raw[i + 1] & 0xC0 != 0x80:
            ends.append(i + 1)
    cut = [0, *ends, len(raw)]
    assert chunk_texts(text) == [raw[a:b] for a, b in zip(cut, cut[1:])]
    assert all(len(c) > C.REACH for c in chunk_texts(text))


def test_rows_do_not_meet():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd efgh") for _ in range(rng.choice([0, 3, 200, 900]))) for _ in range(60)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    s, e, row = C.chunk_ends(data, off)
    for k, t in enumerate(texts):
        assert [data[a:b].tobytes() for a, b in zip(s[row == k], e[row == k])] == (chunk_texts(t) if t else [])


def test_insertion_shifts_only_its_neighbourhood():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    a, b = chunk_texts(text), chunk_texts(text[:2500] + "inserted" + text[2500:])
    assert len(set(a) & set(b)) >= len(a) - 4


def _docs(spark, words):
    rng = random.Random(6)
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(5)]
    rows, planted = [], {}
    for i in range(150):
        w = " ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(rng.randint(30, 200)))
        if i % 3 == 0:
            k = i % 5
            planted.setdefault(k, []).append(i)
            w = w[: len(w) // 2] + " " + passages[k] + " " + w[len(w) // 2 :]
        rows.append((i, w))
    rows += [(300, None), (301, ""), (None, rows[0][1]), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows, planted, passages


def test_planted_passages_are_found_and_others_left(spark, words):
    docs, rows, planted, passages = _docs(spark, words)
    got = C.passages(docs).collect()
    want = {i for v in planted.values() for i in v}
    assert {r["doc_id"] for r in got} == want
    texts = dict(rows)
    for r in got:
        part = texts[r["doc_id"]].encode()[r["first"] : r["last"]].decode()
        assert part in passages[r["doc_id"] % 5] and r["keeper"] == min(planted[r["doc_id"] % 5])


def test_one_copy_stays(spark, words):
    docs, rows, planted, passages = _docs(spark, words)
    out = {r["doc_id"]: r["text"] for r in C.dedup_text(docs).collect()}
    texts = dict(rows)
    for k, ids in planted.items():
        assert out[ids[0]] == texts[ids[0]]
        core = passages[k][120:180]
        assert all(core not in out[i] for i in ids[1:])
    assert all(out[i] == texts[i] for i in range(150) if i % 3)


def test_whole_copies_and_empty(spark, documents, empty):
    assert C.passages(empty).collect() == []
    out = {r["doc_id"]: r["text"] for r in C.dedup_text(documents).collect()}
    assert out[120] == "" or len(out[120]) < 80


def test_ties_end_chunks_in_periodic_text():
    for period in ("belich ", "Ietzte. Stteen Erachtz. ", "-", "=-", "aaaaaaab"):
        text = "some words before it " * 2 + period * (600 // len(period)) + "and quite other words after"
        got = [len(c) for c in chunk_texts(text)]
        assert sum(got) == len(text.encode()) and max(got) < 120 and len(got) < 70


def test_short_and_periodic_passages_are_found(spark, words):
    rng = random.Random(8)
    short = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 5))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(short) for _ in range(n))
    held = [text(51) for _ in range(40)] + [p * (400 // len(p)) for p in ("belich ", "Ietzte. Stteen Erachtz. ", "- ", "-")]
    rows = [(2 * k + j, f"{text(40)} {p} {text(40)}") for k, p in enumerate(held) for j in (0, 1)]
    got = {r["doc_id"] for r in C.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in rows}
