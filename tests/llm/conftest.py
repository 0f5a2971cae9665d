import random

import pytest
from pyspark.sql import types as T


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def odd_rows():
    """Rows that every operator must take: nulls, no words, ties, repeated rows, long texts, near and exact copies."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    base = sentence(80)
    almost = base.split()
    almost[40] = "changed"
    long = "\n".join(sentence(30) for _ in range(120))
    line = "this line stands in several documents as it is"
    texts = [
        None, "", "   ", "...!?", "one", "Two words", base, base, " ".join(almost), base + " more", long, line + "\n" + sentence(12), sentence(9) + "\n" + line, line.replace("several", "severa"),
        "All Rights Reserved. Licensed under the Apache License, Version 2.0.\nGeneral  public, license cc-by CC BY", "mail a.b@c.example.org or +1 (415) 555-0100 at 10.0.0.256 10.0.0.25 card 4111 1111 1111 1111 x 4111111111111112",
        'token = "11acdfb36bb72224148e6160f674b4be45601bff"', "üñí çödé 中文 👍🏽 text\r\nwith odd\x00 signs \x1c and\ttabs", "x" * 3000, "1 2 3 4 " * 50, "some <|endoftext|> text <|startoftext|>", "<|endoftext|>",
    ]
    rows = [(i * 3 + 1, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None), (None, None, None, None, None), (7, "another text of the same id", "en", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
