import random

import pytest

#: Extra columns whose names operators use inside.
SCHEMA = "doc_id long, text string, node long, seed long, score double, s string"


def corpus() -> list[tuple]:
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(90)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "Two words"), (6, "two  WORDS"), (7, "ha " * 700), (8, "é" * 500), (9, "été " * 60)]
    n = 10
    for size in (5, 12, 40, 150, 400):
        base = text(size)
        out.append((n, base))
        out.append((n + 1, base))
        n += 2
        for errors in (1, 1, 2, 3, 8):
            w = base.split(" ")
            for _ in range(errors):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append((n, rng.choice([" ", "\n", "  "]).join(w) if errors == 1 else " ".join(w)))
            n += 1
    for _ in range(12):
        out.append((n, f"{text(rng.randint(5, 60))} {passage} {text(rng.randint(5, 60))}"))
        n += 1
    out.append((n, text(20000)))
    for i in range(30):
        out.append((n + 1 + i, text(rng.randint(1, 120))))
    out.append((n + 30, out[-1][1]))  # a row that is there twice
    for i in (2**62, 2**63 - 2, -(2**62)):  # hashes for ids
        out.append((i, f"{out[-3][1]} {passage} {base}"))
        base = base.replace(words[0], words[1])
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, "x") for i, t in rows], SCHEMA).repartition(5)
    return df.cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
