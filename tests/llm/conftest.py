import pytest


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes small tables as a folder that the queries read; documents get null, empty, long and repeated texts and an extra column."""

    def write(name, **frames):
        folder = tmp_path_factory.mktemp(name)
        for table, df in frames.items():
            df.write.parquet(f"{folder}/{table}.parquet")
        return str(folder)

    return write


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact copies, near copies, shared passages, odd white space, nulls and long runs."""
    import random

    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = words(50)
    texts = []
    for _ in range(25):
        own = words(r.randint(60, 160))
        texts.append(" ".join(own))
        near = own.copy()
        near[r.randrange(len(near))] = "changed"
        texts.append("  ".join(near).upper() if r.random() < 0.3 else "\n".join(near))
        texts.append(" ".join(words(20) + passage + words(30)))
    texts += [texts[0], texts[0], texts[3]]
    hub = words(120)
    for _ in range(12):
        near = hub.copy()
        for _ in range(2):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [None, "", "   ", "one", "one", "one two", "ONE two", "x " * 300, "y" * 5000, "é ü\u00a0ß 日本 " * 30, "<|endoftext|> a <|endoftext|>"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit(1), "component_id": F.lit("clash")})
