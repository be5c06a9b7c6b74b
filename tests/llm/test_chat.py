import random

from factloom.llm import chat


def brute(rows):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    out = set()
    for c, v in conv.items():
        if not any(w[: len(v)] == v and (len(w) > len(v) or d < c) for d, w in conv.items() if d != c):
            out.add((c, len(v), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        n = rng.randrange(1, 6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no", None, ""])) for t in range(n)]
    rows += [(100, t, "user", "x" * 3000) for t in range(300)] + [(101, t, "user", "x" * 3000) for t in range(200)]
    rows += [(None, 0, "user", "hi"), (102, None, None, None), (103, 1, "user", "b"), (103, 1, "user", "a"), (103, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "2 AS h0", "'x' AS last")
    assert {tuple(r) for r in chat.render(df).collect()} == brute(rows)
    assert chat.render(df.limit(0)).collect() == []
