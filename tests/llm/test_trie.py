import hashlib
import random
import zlib

import xxhash

from factloom.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def key(role, text, k=b"0"):
    """Spark's xxhash64 of (k, role, text), signed: each hash is the next one's seed."""
    h = 42
    for x in (k, role.encode(), text.encode()):
        h = xxhash.xxh64_intdigest(x, seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, opening=True):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((t is not None, t or 0, key(r, x), key(r, x, b"1"), r, x))
    convs = {c: [x[4:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if opening else 0
        built[c] = convs.get(c - c % 20, [])[:h] + v[h:]
    node = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            node.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in node:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    out = []
    for p in sorted(node, key=len, reverse=True):
        words = len(p[-1][1].encode().split()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(node[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
        ends = ",".join(str(c) for c in sorted(c for c in node[p] if len(built[c]) == len(p)))
        out.append((min(node[p]), len(p), min(node[p[:-1]]) if p else None, len(node[p]), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(spark, rows, opening=True):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS depth", "1 AS k0", "2 AS words", "3 AS n", "4 AS up", "5 AS piece")
    return sorted(tuple(r) for r in T.prefix_trie(df, T.with_shared_openings if opening else T.as_logged).collect())


def conversations(rng, n, turns=6, says=3):
    rows = []
    for c in rng.sample(range(n * 2), n):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi there", "yes", "no no no", None, ""][:says])) for t in range(rng.randrange(1, turns))]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = conversations(rng, 150)
    rows += [(1000 + c, t, "user", f"common {t}") for c in range(40) for t in range(3)]  # one very common conversation
    rows += [(None, 0, "user", "hi"), (2001, None, None, None), (2001, 0, "user", "b"), (2002, 1, "user", "b"), (2002, 1, "user", "a"), (2002, 1, "user", "a"), (2002, None, "user", "c")]
    rows += [(3000 + c, 0, "user", f"only turn {c % 5}") for c in range(60)]  # some lose it and are turnless
    assert got(spark, rows) == brute(rows)


def test_long_conversations_cross_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 16)
    monkeypatch.setattr(T, "IDS", 4)
    rng = random.Random(4)
    long = [("user", f"turn {t} {rng.randrange(9)}") for t in range(150)]
    rows = []
    for c in range(1, 40):
        n, cut = rng.randrange(1, 150), rng.randrange(150)
        rows += [(c, t, *(x if t < cut else (x[0], f"own {c // 3} {t}"))) for t, x in enumerate(long[:n])]
    assert got(spark, rows, False) == brute(rows, False)


def test_deep_tree_of_chains(spark):
    """Each conversation leaves the one before a turn later: chains hang in a row."""
    rows = [(c, t, "user", "go" if t < c else f"left {c}") for c in range(24) for t in range(c + 2)]
    assert got(spark, rows, False) == brute(rows, False)


def test_one_conversation_and_none(spark):
    assert got(spark, [(7, 0, "user", "a b c")], False) == brute([(7, 0, "user", "a b c")], False)
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
