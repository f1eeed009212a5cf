import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def documents(spark, words):
    """Documents with copies, near copies, repeated lines, long and empty texts, nulls and repeated rows."""
    rng = random.Random(7)
    texts = {}
    for i in range(120):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 14))) for _ in range(rng.randint(1, 8))]
        texts[i] = "\n".join(lines)
    for i in range(120, 135):
        texts[i] = texts[i % 5]  # groups of copies
    for i in range(135, 150):  # near copies: one word changed
        w = texts[10 + i % 3].split(" ")
        w[i % len(w)] = "changed"
        texts[i] = " ".join(w)
    passage = " ".join(rng.choice(words) for _ in range(60))
    for i in range(150, 158):
        texts[i] = texts[i - 100] + "\n  " + "This very line is found in SEVERAL documents of the table \t\n" + passage + " " + texts[i - 90]
    texts[158], texts[159], texts[160], texts[161] = "", None, " \n\t\n", "één ÉÉN ü"
    texts[162] = "\n".join(" ".join(rng.choice(words) for _ in range(10)) for _ in range(3000))
    rows = [(i, t, None if i % 17 == 0 else "en", None if i % 29 == 0 else f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    rows += [rows[3], rows[140], (None, texts[4], "en", "s0", 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crc():
    return lambda key, n: zlib.crc32(str(key).encode()) % n
