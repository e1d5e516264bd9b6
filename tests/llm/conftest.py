import random

import pytest

WORDS = "the a of and to stone river green walk light under quick seven paper glass morning window table north sound".split()


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with every odd case, as a list and as a table with extra columns whose names clash."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    rows = [(i, text(rng.randint(5, 120)), f"s{i % 4}") for i in range(120)]
    base = text(200)
    rows += [(200 + i, base, "s0") for i in range(40)]  # a large group of copies
    rows += [(240 + i, base + f" Extra{i}", "s0") for i in range(10)]
    rows += [(260, base.replace(" ", "\n\t"), "s1"), (261, None, "s1"), (262, "", None), (263, " \n\t ", None), (264, None, None)]
    rows += [(265, text(6000), "s2"), (266, "x" * 50_000, "s2"), (267, "AB ab é 日本 \x0b end", "s3"), (267, "AB ab é 日本 \x0b end", "s3")]
    rows += [(268, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 30, "s3"), (None, "no id here at all", "s3"), (270, "a\nb\na\n\n \na", "s1")]
    schema = "doc_id long, text string, source string, size string, kept string, rid int, h int, fp int"
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 2, 3) for r in rows], schema).repartition(5)
    return rows, df.cache()


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus[1].filter("false")
