import random

import pytest

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, node long, bucket string, `key` int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    r = random.Random(5)
    words = "the of and der la cat dog sat été Haus casa grande lamp stone river 1984 #tag".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(120) for _ in range(4)]
    texts = [None, "", "   \n\t", "word", "a b c", "x" * 3000, text(3000), "the the the " * 80, *base, base[0] + " end", base[1].replace("cat", "cow", 1), *(base[2] + "\n" + text(40) for _ in range(3))]
    rows = [(t, i, r.choice(["en", "de", None]), r.choice(["src0", "src0", None, "b"]), None, i, "x", 1) for i, t in enumerate(texts)]
    rows += [(base[3], None, "en", "src0", 5, 1, None, None), rows[8], rows[8], (text(60), 9, "en", None, 1, None, "y", 2)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
