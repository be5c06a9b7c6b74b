"""Substring dedup: relative Lempel-Ziv factors of documents against all earlier ones.

Every document is parsed greedily against the reference, which is the whole corpus in blocks
of ``window`` words. The index holds each different block once, at the smallest doc_id that
has it, once (of a copied stretch of blocks: where the stretch first occurs). A factor begins where
the parse stands, and runs as long as the following blocks continue inside the same
reference document. Where it ends, the blocks over the boundary are looked up too: of those
that hold the next word, the one whose match reaches furthest carries on, cut at the boundary.
Where none does, words are literals up to the next indexed block. So factors never overlap,
each names its reference document and place, and a repeat is found wherever it lies.

The index is kept small in three steps, none of which loses a block:
1. Anchors. A block's anchor is the least hash of its ``gram``-word sequences. Equal blocks
   have equal anchors; blocks whose anchor is in one document only are left out.
2. Stretches. Neighbouring blocks that are left form a stretch; equal stretches (copies)
   are indexed once, under their smallest doc_id. Then blocks whose anchor is in one of
   these different stretches only are left out as well.
3. Blocks of the stretches are joined to their smallest doc_id. A frequent block is
   combined before the shuffle; blocks with a noticeable share of all rows are joined apart.

Blocks are compared by two independent 64-bit hashes of their words' two independent hashes.

A null or empty text has no words; very long ones are read whole. Rows with one doc_id don't remove words from one
another; rows with a null doc_id keep all words and are no reference. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .durable import join_by_share, settle

WINDOW, GRAM = 50, 10


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """min(h[i:i+width]) for every i where it fits, in log2(width) passes."""
    n = len(h) - width + 1
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[width - have : width - have + n])


def _anchors(w: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each block of a document's word hashes."""
    if len(w) < window:
        return np.zeros(0, np.uint64)
    return _sliding_min(tk.window_hashes(w, gram), window - gram + 1)


def _rows(column, twice: bool = True):
    """Each row's words (hashes), these by the other way of hashing, and bytes."""
    for lo, hi, data, offs in tk.blocks(column):
        starts, ends, first = tk.words(data, offs)
        w = tk.word_hashes(data, starts, ends)
        v = tk.word_hashes(data, starts, ends, 1) if twice else w
        for i in range(hi - lo):
            yield lo + i, w[first[i] : first[i + 1]], v[first[i] : first[i + 1]], data[offs[i] : offs[i + 1]]


def _scan(window: int, gram: int):
    def fn(batches):
        for b in batches:
            n, sha, anchors = [], [], []
            for _, w, _, raw in _rows(b.column(1), False):
                n.append(len(w))
                sha.append(hashlib.sha256(b" ".join(raw.tobytes().split())).hexdigest())
                anchors.append(np.unique(_anchors(w, window, gram)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(anchors, pa.list_(pa.int64()))], names=["doc_id", "n_words", "sha", "anchors"])

    return fn


_RUN = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("more", pa.int64()), ("anchors", pa.list_(pa.int64()))]))


def _stretches(window: int, gram: int):
    def fn(batches):
        for b in batches:
            shared = b.column("shared")
            runs = []
            for i, w, v, _ in _rows(b.column("text")):
                a = _anchors(w, window, gram)
                hit = np.zeros(len(a) + 2, np.int8)
                hit[1:-1] = np.isin(a, shared[i].values.to_numpy().view(np.uint64))
                step = np.diff(hit)
                out = []
                for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
                    end = e + window - 1
                    out.append({"start": s, "n": e - s, "hash": int(tk.sequence_hash(w[s:end]).view(np.int64)), "more": int(tk.sequence_hash(v[s:end]).view(np.int64)), "anchors": np.unique(a[s:e]).view(np.int64)})
                runs.append(out)
            keep = [c for c in b.schema.names if c != "shared"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(runs, _RUN)], names=[*keep, "runs"])

    return fn


def _blocks(window: int, gram: int):
    def fn(batches):
        for b in batches:
            doc = b.column("doc_id").to_numpy()
            runs = b.column("runs")
            for rows in _groups(_rows(b.column("text")), 64):
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                for i, w, v, _ in rows:
                    a = _anchors(w, window, gram)
                    for r in runs[i]:
                        s, n, run = r["start"].as_py(), r["n"].as_py(), r["run"].as_py()
                        end = s + n + window - 1
                        at = np.flatnonzero(np.isin(a[s : s + n], r["anchors"].values.to_numpy().view(np.uint64)))
                        k, more = tk.window_hashes(w[s:end], window)[at], tk.window_hashes(v[s:end], window)[at]
                        for c, x in zip(out, (k.view(np.int64), more.view(np.int64), np.full(len(at), doc[i]), np.full(len(at), run), at.astype(np.int32), (s + at).astype(np.int32))):
                            c.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["k", "more", "doc_id", "run", "at", "place"])

    return fn


def _groups(rows, n: int):
    """Lists of up to n rows."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def factors(doc: np.ndarray, place: np.ndarray, found: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (first word, words, reference document, first word there) of each factor.

    Where ``found``, the block that begins at a word is indexed at that document and place.
    """
    starts = np.flatnonzero(found)
    if not len(starts):
        return []
    d, p = doc[starts], place[starts]
    new = np.append(True, (np.diff(starts) != 1) | (d[1:] != d[:-1]) | (np.diff(p) != 1))
    first = np.flatnonzero(new)
    begin, ref, at = starts[first].tolist(), d[first].tolist(), p[first].tolist()
    end = (starts[np.append(first[1:], len(starts)) - 1] + window).tolist()
    out, word, k = [], 0, 0
    while k < len(begin):
        # The matches are sorted by their ends; the last one that begins by now reaches furthest.
        while k + 1 < len(begin) and begin[k + 1] <= word:
            k += 1
        word = max(word, begin[k])
        if word < end[k]:
            out.append((word, end[k] - word, ref[k], at[k] + word - begin[k]))
            word = end[k]
        k += 1
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int64())]))


def _cut(window: int):
    def fn(batches):
        for b in batches:
            n, removed, sha, spans = [], [], [], []
            for i, text in enumerate(b.column("text")):
                word = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                size = max(0, len(word) - window + 1)
                doc, place, found = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
                for r in b.column("parts")[i].as_py() or []:
                    if r["lo"] is not None:
                        at = np.arange(r["start"], r["start"] + r["n"])
                        doc[at], place[at] = r["lo"], r["lo_start"] + np.arange(r["n"])
                    else:
                        at = r["start"] + np.array([x["at"] for x in r["ats"]], np.int64)
                        doc[at], place[at] = [x["lo"] for x in r["ats"]], [x["place"] for x in r["ats"]]
                    found[at] = True
                fac = factors(doc, place, found, window)
                keep = np.ones(len(word), bool)
                for s, m, _, _ in fac:
                    keep[s : s + m] = False
                n.append(len(word))
                removed.append(int((~keep).sum()))
                kept = b" ".join(word[j] for j in np.flatnonzero(keep).tolist())
                sha.append(hashlib.sha256(kept).hexdigest())
                spans.append((kept.decode("utf-8", "replace") if fac else text.as_py(), [dict(zip(("start", "words", "ref_doc_id", "ref_start"), f)) for f in fac]))
            keep = [c for c in b.schema.names if c not in ("text", "parts")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array([x for x, _ in spans]), pa.array([x for _, x in spans], _SPANS)],
                names=[*keep, "n_words", "n_removed", "kept_sha256", "kept_text", "spans"],
            )

    return fn


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents without repeats, documents with them).

    The first holds doc_id, n_words, kept_sha256 of the rows that share no anchor; the second
    doc_id, the columns named in ``carry``, n_words, n_removed, kept_sha256, kept_text (the text
    as it was where nothing is removed), spans of the rest. A span is a factor: first word, words,
    and the reference's doc_id and first word (if several rows have that doc_id, in one of them).
    """
    docs = docs.select("doc_id", "text", *carry)
    extra = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    scan = settle(docs.select("doc_id", "text").mapInArrow(_scan(window, gram), "doc_id long, n_words long, sha string, anchors array<long>"), "scan")
    anchor = scan.where("doc_id is not null").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = anchor.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    per_doc = settle(anchor.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared")), "shared")
    flagged = docs.join(per_doc, "doc_id").withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "doc_id", *carry, "text", "shared")
    flagged = settle(flagged.mapInArrow(_stretches(window, gram), f"row_id long, doc_id long, {extra}text string, runs array<struct<start:int,n:int,hash:long,more:long,anchors:array<bigint>>>"), "stretches")
    runs = flagged.select("row_id", "doc_id", F.inline("runs"))
    first = runs.groupBy("hash", "more").agg(F.min(F.struct("doc_id", "row_id", "start", "n", "anchors")).alias("one"))
    first = settle(first.select("hash", "more", "one.*").withColumn("run", F.monotonically_increasing_id()), "first")
    anchor = first.select("run", F.explode("anchors").alias("anchor"))
    shared = anchor.groupBy("anchor").agg(F.min("run").alias("lo"), F.max("run").alias("hi")).where("lo < hi").select("anchor")
    left = anchor.join(shared, "anchor").groupBy("run").agg(F.collect_list("anchor").alias("anchors"))
    mine = first.drop("anchors").join(left, "run").groupBy("row_id").agg(F.collect_list(F.struct("start", "n", "run", "anchors")).alias("runs"))
    block = flagged.drop("runs").join(mine, "row_id").select("doc_id", "text", "runs").mapInArrow(_blocks(window, gram), "k long, more long, doc_id long, run long, at int, place int")
    block = settle(block, "blocks")
    # Flat buffers keep this a hash aggregate; of a block that its document holds twice, either place will do.
    least = block.groupBy("k", "more").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("place", "doc_id").alias("lo_place"), F.count("*").alias("n"))
    least = least.where("lo < hi").drop("hi")
    known = join_by_share(block, least, ["k", "more"], "n").where("doc_id > lo")
    known = known.groupBy("run").agg(F.collect_list(F.struct("at", "lo", F.col("lo_place").alias("place"))).alias("ats"))
    first = first.join(known, "run", "left").select("hash", "more", F.col("doc_id").alias("lo"), F.col("start").alias("lo_start"), "ats")
    part = runs.join(first, ["hash", "more"]).where("doc_id > lo or ats is not null")
    copy = F.col("doc_id") > F.col("lo")
    part = part.select("row_id", F.struct("start", "n", F.when(copy, F.col("lo")).alias("lo"), F.when(copy, F.col("lo_start")).alias("lo_start"), F.when(~copy, F.col("ats")).alias("ats")).alias("p"))
    part = part.groupBy("row_id").agg(F.collect_list("p").alias("parts"))
    cut = flagged.drop("runs").join(part, "row_id", "left").select("doc_id", *carry, "text", "parts")
    span = "array<struct<start:long,words:long,ref_doc_id:long,ref_start:long>>"
    cut = cut.mapInArrow(_cut(window), f"doc_id long, {extra}n_words long, n_removed long, kept_sha256 string, kept_text string, spans {span}")
    clean = scan.join(per_doc.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_words", F.col("sha").alias("kept_sha256"))
    return clean, cut
