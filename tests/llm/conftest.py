import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, size int, shard string, slot int, id int, x double, tag string, epoch int, start bigint, kept boolean, row int, `key` string, `_text` string, `t` string"


def odd_rows():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(80)
    long = prose(6000) + "\n" + "x" * 3000
    texts = [
        (1, base), (2, base), (3, base + " tail"), (4, base.upper()), (5, ""), (6, None), (7, " \t\n\x0b "), (8, "one two"), (9, "one two three four"), (10, "ONE two three four"),
        (11, long), (12, long[:20000]), (13, "a b a b a b a b a b " * 20), (14, "line here\n" * 40), (15, "naïve café – “ünï” 数据 👍 ½²   end\x1c" * 5), (16, "say <|endoftext|> twice <|endoftext|>"),
        (17, "</s>[INST] \\1 <<SYS>>"), (None, base + " other end"), (None, "null key text"), (None, None), (18, prose(100)), (18, prose(100)), (19, base), (19, base), (20, "  two  spaces \n newline\r\n tab\t end "), (21, "it's they'll 12 345 _x_ a_b ++--"),
    ]
    return [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), len(t or ""), k, None, "s", 3, 4, 0.5, None, 1, 9, None, 2, "k", None, "t") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
