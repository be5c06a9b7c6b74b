import random

import pytest

from factloom.llm import viterbi

from . import cases

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


def reference(vocab):
    """A unigram tokenizer; it needs an unknown piece and byte pieces, which texts here don't spell."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    if vocab[0][0] != "<unk>":
        vocab = [("<unk>", 0.0), *((f"<0x{b:02X}>", -1.0) for b in range(256)), *vocab]
    t = Tokenizer(models.Unigram(vocab, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=viterbi.SPACE, prepend_scheme="always", split=True)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def test_counts_equal_the_tokenizer(spark):
    vocab = viterbi.vocabulary(PATH)
    count = reference(vocab)
    rows = cases.texts() + [(700, "Hello  world, don't  stop"), (701, " lead"), (702, "trail "), (703, "日本 \U0001f600 ok\n\nnext"), (704, "▁odd▁one")]
    got = {r.doc_id: r.n_tokens for r in viterbi.token_counts(cases.docs(spark, rows, extra=True), PATH).collect()}
    assert got == {i: count(t or "") for i, t in rows}
    assert viterbi.token_counts(cases.docs(spark, []), PATH).collect() == []


def plain(text):
    """Best score and fewest steps to it, straight from the file: every piece at every place."""
    import math

    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=PATH)
    real = [i for i in range(p.get_piece_size()) if p.encode(p.id_to_piece(i)) is not None and not (p.IsControl(i) or p.IsByte(i) or p.IsUnknown(i))]
    rank = {p.id_to_piece(i): r for r, i in enumerate(sorted(real, key=lambda i: (-p.get_score(i), i)))}
    low = -math.log(len(rank) - 1 + 2.7) - 10
    total = 0.0
    for w in (" " + text).replace(" ", viterbi.SPACE + "\0")[0:].split(viterbi.SPACE)[1:]:
        w = viterbi.SPACE + w[1:]
        best = [0.0] + [-math.inf] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(max(0, e - 20), e):
                if w[s:e] in rank:
                    best[e] = max(best[e], best[s] - math.log(rank[w[s:e]] + 2.7))
            if w[e - 1] not in rank:
                best[e] = max(best[e], best[e - 1] + low)
        total += best[-1]
    return total


def test_names_of_bytes_and_controls_are_text():
    c = viterbi.Counter(viterbi.vocabulary(PATH))
    for t in ("<0x41> byte", "<s> a </s>", "internationalization of tokenizers", "<unk>", "plain words here"):
        n, s = c.text(t)
        assert s == pytest.approx(plain(t)), t
    assert c.text("<s>")[0] > 1 and c.text("<0x41>")[0] > 1


def test_counts_come_near_the_files_own_tokenizer():
    import glob

    import pyarrow.parquet as pq
    import sentencepiece

    found = glob.glob("/root/testdata/sf0.001/documents.parquet")
    if not found:
        pytest.skip("no test tables")
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    c = viterbi.Counter(viterbi.vocabulary(PATH))
    texts = [t for t in pq.read_table(found[0]).column("text").to_pylist() if t]
    want, got = sum(len(own.encode(t)) for t in texts), sum(c.text(t)[0] for t in texts)
    assert abs(got - want) < 0.1 * want, (got, want)


def test_null_ids_and_repeats(spark):
    got = sorted(((r.doc_id, r.n_tokens) for r in viterbi.token_counts(cases.docs(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]), PATH).collect()), key=str)
    assert got == sorted([(1, 2), (1, 2), (None, 2), (None, 0)], key=str)


def test_ties_of_random_vocabularies():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {"<unk>": 0.0} | {f"<0x{b:02X}>": -9.0 for b in range(256)}
        while len(pieces) < 275:
            pieces["".join(rng.choice("ab▁c") for _ in range(rng.randrange(1, 5)))] = float(-rng.randrange(1, 4))
        count = reference(list(pieces.items()))
        c = viterbi.Counter(list(pieces.items()))
        for _ in range(10):
            t = "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 25)))
            assert c.text(t)[0] == count(t), t
