import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, k int, h double, _id long, row string"


@pytest.fixture(scope="session")
def documents(spark):
    """A small table with the hard cases: nulls in every column, empty and
    long texts, repeated rows, ids used twice, near copies, shared passages,
    repeated lines, and columns named like helper columns."""
    rng = random.Random(5)
    words = [a + b for a in ("th", "an", "er", "ß", "on", "qu", "le") for b in ("e", "ing", "é", "ation", "st", "", "or", "ul")]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, long_line = prose(60), prose(30)
    base = prose(200)
    texts = [None, "", " \n\t ", "one", "a b c", prose(5), base, base, base + " tail", base.replace(" ", "  ", 3)]
    for _ in range(8):
        w = base.split(" ")
        w[rng.randrange(200)] = "edit"
        texts.append(" ".join(w))
    texts += [prose(40) + "\n" + passage + "\n" + prose(40) for _ in range(6)]
    texts += ["\n".join(["x", "y", "z", "w", prose(20)]) for _ in range(4)]
    texts += ["\n".join([prose(3), long_line, prose(3)]) for _ in range(3)]
    texts += [long_line + "\n" + long_line, "l\n" * 12, "spam spam " * 30, "a" * 5000, " " * 1000, "ab " * 3000]
    texts += [prose(rng.randrange(1, 120)) for _ in range(40)] + [prose(20000)]
    rows = [(i, t, "en", f"src{i % 3}", None, "x", 1, 0.5, i, "r") for i, t in enumerate(texts)]
    rows += [(6, base, "en", "src0", 1, None, None, None, None, None)] * 2 + [(7, "other text of id seven", None, None, None, None, None, None, None, None)]
    rows += [(None, passage + " and more", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
