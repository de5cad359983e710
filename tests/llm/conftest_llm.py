import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(df, key="doc_id"):
    """Rows as dictionaries, by key and then by everything (null keys first)."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r[key] is not None, r[key] or 0, str(r)))


@pytest.fixture(scope="session")
def corpus(spark):
    """300 documents: random prose with copies, near copies, shared passages and odd cases."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(500)]
    line = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))
    shared = [line() + " " + line() + " " + line() for _ in range(6)]
    texts = []
    for i in range(300):
        roll = rng.random()
        if roll < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif roll < 0.35 and texts:
            words = (rng.choice(texts) or "").split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            lines = [line() for _ in range(rng.randint(1, 8))]
            if rng.random() < 0.4:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
            texts.append("\n".join(lines))
    texts += [None, "", "", " \n\t ", "x", "é ß 漢字 🙂 naïve café", "a" * 5000, "ab" * 3000, "mail bob.smith@mail.example.com or +1 (212) 555-0199 now", "A  b\tc", "A b c"]
    langs = [rng.choice(["en", "de"]) for _ in texts]
    texts = [t if t is None or i % 3 else t.replace("a", "ä") for i, t in enumerate(texts)]
    rows = [(i * 3 + 1, t, langs[i], "s", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, null columns, extra columns whose names the operators use themselves."""
    rows = [(1, "one two three four five", 9, "x", 5), (1, "one two three four five", 9, "x", 5), (None, "one two three four five", 8, None, None), (None, None, None, None, None), (2, "", 1, "y", 0), (None, "alone here", 1, "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, row string, n long").withColumns({"place": __import__("pyspark").sql.functions.lit(1), "kept": __import__("pyspark").sql.functions.lit("k")})
