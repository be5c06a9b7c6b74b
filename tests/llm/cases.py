"""Small tables with the awkward cases every operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def sentence(rng: random.Random, n: int, vocab: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def texts(seed: int = 3) -> list[tuple[int, str | None]]:
    """Distinct texts, copies, near copies, shared passages, empty, null, blank and one very long text."""
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    out: list[str | None] = [sentence(rng, rng.randrange(1, 300)) for _ in range(40)]
    out += [f"{sentence(rng, 20)} {passage}\n{sentence(rng, 15)}" for _ in range(8)]
    base = sentence(rng, 160).split()
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        out.append(" ".join(w))
    out += [out[0], out[0], "", None, " \t\n", "one", "One two", "one two", sentence(rng, 30_000), "ÄÖ ß é 日本語 текст\x0btab", "a" * 5000]
    return list(enumerate(out))


def docs(spark, rows=None, extra=False):
    rows = texts() if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 4}" if (i or 0) % 11 else None, len(t or "")) for i, t in rows], DOCS)
    if extra:
        for c in ("component_id", "kept", "group", "id", "ids", "start", "length", "rank", "size", "score", "row_id", "runs", "hash", "u", "n"):
            df = df.selectExpr("*", f"'clash' AS `{c}`")
    return df


def words(t: str | None) -> list[bytes]:
    return (t or "").encode().split()
