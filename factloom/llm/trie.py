"""Prefix trie of conversations: nodes are distinct sequences of first turns.

A node belongs to its smallest member. Of a conversation's prefixes it owns all from some depth on
(what shares a longer prefix shares the shorter one), so its nodes are a chain, and the trie
is these chains, each hung below a node of a smaller conversation.

1. Turns are numbered: a range sort, numbers within each range, and the few numbers that
   conversations bring along from one range to the next. So a conversation may be of any length.
2. Each prefix has a digest, the exclusive or of two hashes of its turns at their places, summed up
   within pieces of ``PIECE`` turns and then over pieces.
3. Minima: each digest's smallest conversation and its number of conversations.
4. Binary search: all conversations at once probe the middle of the depths that are left to them;
   the probe joins the prefixes for its digest and the minima for that digest under its own
   conv_id. Both tables are bucketed by these keys and are not shuffled again.
5. The digest just above a chain names the node it hangs from; for a conversation that owns
   nothing, that is the node where it ends.
6. Chains are summed bottom-up by doubling: in round k a chain's sum takes in those of the chains
   2**k levels below. Sums along a chain then run in pieces, as the digests did.
7. Ids of conversations that end in a node are joined in order, first within ranges; a node's
   pieces then pass through one digest, which no group has to be held for.

Turns are ordered by turn, null first, and those that tie by the signed value of their digest.
Null roles and texts count as empty; rows without conv_id belong to no conversation and are left
out. Repeated rows are turns of their own. Texts are hashed and counted whole where they are read and go no
further. Other columns are ignored; an empty table gives an empty result, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import bucketed, drop_bucketed, join_by_share, settle, shuffle_width

PIECE = 1024
WORD = r"[^\x20\x09-\x0D]+"
AT = ["conv_id", "depth"]
DIGEST = ["depth", "k0", "k1"]


def _number(batches):
    """Number each conversation's turns within a sorted partition."""
    last, count = None, 0
    for b in batches:
        c = b.column("conv_id").to_numpy()
        if not len(c):
            continue
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        i = np.arange(len(c))
        n = i - np.maximum.accumulate(np.where(new, i, 0)) + 1
        if last is not None and c[0] == last:
            n[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(c)] += count
        last, count = c[-1], int(n[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "n"])


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a and b (digests of role and text), words, for each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit("0"), role, text).alias("a"), F.xxhash64(F.lit("1"), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    t = settle(t, "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "a", "b"]
    schema = "conv_id long, turn long, a long, b long, words long, n long"
    part = t.repartitionByRange(shuffle_width(t.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_number, schema)
    part = settle(part.withColumn("range", F.spark_partition_id()), "numbered")
    # A range passes on one conversation at most: fewer rows than ranges.
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    brought = part.groupBy("conv_id", "range").agg(F.max("n").alias("m")).withColumn("base", F.sum("m").over(before)).where("base is not null")
    part = part.join(F.broadcast(brought.select("conv_id", "range", "base")), ["conv_id", "range"], "left")
    return part.select("conv_id", (F.col("n") + F.coalesce("base", F.lit(0))).alias("pos"), "a", "b", "words")


def as_logged(conv_id: Column) -> tuple[Column, Column]:
    """Each conversation as it is: no turns of another."""
    return conv_id, F.lit(0)


def with_shared_openings(conv_id: Column) -> tuple[Column, Column]:
    """The conversation that lends its opening, and how many turns of it at most: checksum of the id modulo 4, of every twentieth id."""
    return conv_id - conv_id % 20, (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("long")


def rebuilt(turns: DataFrame, opening=as_logged) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of all conversations, and their turns (conv_id, depth from 1, a, b, words).

    ``opening(conv_id)`` gives another conversation and a small number h: its first h turns take the
    place of the own first h.
    """
    own = settle(numbered(turns), "own")
    base, h = opening(F.col("conv_id"))
    size = own.groupBy("conv_id").agg(F.max("pos").alias("own_n"))
    convs = size.select("conv_id", "own_n", base.alias("base"), h.alias("h"))
    convs = convs.join(size.select(F.col("conv_id").alias("base"), F.col("own_n").alias("base_n")), "base", "left")
    lent = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = settle(convs.select("conv_id", "own_n", "base", "h", lent.alias("lent"), (lent + F.greatest(F.lit(0), F.col("own_n") - F.col("h"))).alias("n")), "convs")
    kept = own.where(F.col("pos") > h)
    rest = join_by_share(kept, convs.select("conv_id", "h", "lent", "own_n"), ["conv_id"], "own_n")
    rest = rest.select("conv_id", (F.col("lent") + F.col("pos") - F.col("h")).alias("depth"), "a", "b", "words")
    most = convs.agg(F.max("lent")).first()[0] or 0
    head = own.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(convs.where("lent > 0").select("conv_id", "base", "lent"), "base").where("pos <= lent")
    return convs.select("conv_id", "n"), rest.unionByName(head.select("conv_id", F.col("pos").alias("depth"), "a", "b", "words"))


def along(df: DataFrame, values: dict, fold, downwards: bool) -> DataFrame:
    """``values`` (name: column) folded from the first depth to each row's, or from the last: within pieces of a chain, then over pieces."""
    piece = F.floor(F.col("depth") / PIECE)
    df = df.withColumn("piece", -piece if downwards else piece)
    order = F.desc("depth") if downwards else F.asc("depth")
    here = Window.partitionBy("conv_id", "piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    total = df.groupBy("conv_id", "piece").agg(*[fold(v).alias(f"{k}_t") for k, v in values.items()])
    total = total.select("conv_id", "piece", *[fold(f"{k}_t").over(before).alias(f"{k}_b") for k in values]).where(F.col(f"{next(iter(values))}_b").isNotNull())
    df = df.select("*", *[fold(v).over(here).alias(f"{k}_h") for k, v in values.items()])
    df = df.join(total, ["conv_id", "piece"], "left")
    drop = [f"{k}_{x}" for k in values for x in "hb"]
    both = {k: _both(fold, F.col(f"{k}_h"), F.col(f"{k}_b")) for k in values}
    return df.withColumns(both).drop("piece", *drop)


def _both(fold, here: Column, before: Column) -> Column:
    rest = F.coalesce(before, F.lit(0))
    return here.bitwiseXOR(rest) if fold is F.bit_xor else here + rest


def first_owned(convs: DataFrame, root: Column, prefix: DataFrame, least: DataFrame) -> DataFrame:
    """conv_id, n, f: the first depth that the conversation owns, n + 1 if none; the smallest one owns the root."""
    prefix, least = prefix.select(*AT, "k0", "k1"), least.select(*AT, "k0", "k1")
    at_root = F.col("conv_id") == root
    state = settle(convs.select("conv_id", "n", F.when(at_root, 0).otherwise(1).cast("long").alias("lo"), F.when(at_root, 0).otherwise(F.col("n") + 1).alias("hi")), "search")
    done = state.where("lo = hi")
    left = state.where("lo < hi")
    while left.limit(1).count():
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        probe = left.withColumn("depth", mid).join(prefix, AT)
        own = probe.join(least.withColumn("owned", F.lit(True)), [*AT, "k0", "k1"], "left").withColumn("owned", F.col("owned").isNotNull())
        step = own.select("conv_id", "n", F.when(F.col("owned"), F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(F.col("owned"), F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        state = settle(step, "search")
        done = done.unionByName(state.where("lo = hi"))
        left = state.where("lo < hi")
    return done.select("conv_id", "n", F.col("lo").alias("f"))


def chain_sums(chains: DataFrame, values: list[str]) -> DataFrame:
    """``chains`` (conv_id, ptr: the chain it hangs from) with each of ``values`` summed over the chain and all below."""
    state = settle(chains, "chains")
    while True:
        below = state.where("ptr is not null").groupBy("ptr").agg(F.count("*").alias("k"), *[F.sum(v).alias(f"{v}_s") for v in values])
        below = settle(below, "below")
        if not below.limit(1).count():
            return state.drop("ptr")
        hop = below.select("ptr", "k").join(state.select(F.col("conv_id").alias("ptr"), F.col("ptr").alias("next")), "ptr")
        live = join_by_share(state.where("ptr is not null"), hop, ["ptr"], "k").drop("ptr").withColumnRenamed("next", "ptr")
        every = live.unionByName(state.where("ptr is null"))
        sums = below.drop("k").withColumnRenamed("ptr", "conv_id")
        every = every.join(sums, "conv_id", "left").withColumns({v: F.col(v) + F.coalesce(f"{v}_s", F.lit(0)) for v in values})
        state = settle(every.drop(*[f"{v}_s" for v in values]), "chains")


IDS = 4096


def _pieces(limit: int):
    """Sorted (conv_id, depth, member) to one row for each node and up to ``limit`` members: their decimals, joined by commas."""

    def fn(batches):
        held: tuple[int, int] | None = None
        ids: list[int] = []
        for b in batches:
            out = []
            for c, d, m in zip(*(b.column(k).to_pylist() for k in ("conv_id", "depth", "member"))):
                if held != (c, d) or len(ids) >= limit:
                    if ids:
                        out.append((*held, ids[0], ",".join(map(str, ids))))
                    held, ids = (c, d), []
                ids.append(m)
            if out:
                yield _rows(out, [pa.int64()] * 3 + [pa.string()], [*AT, "low", "ids"])
        if ids:
            yield _rows([(*held, ids[0], ",".join(map(str, ids)))], [pa.int64()] * 3 + [pa.string()], [*AT, "low", "ids"])

    return fn


def _digest(batches):
    """Pieces sorted by (conv_id, depth, low) to a node's digest; one digest is open at a time."""
    held, sha = None, None
    for b in batches:
        out = []
        for c, d, ids in zip(*(b.column(k) for k in ("conv_id", "depth", "ids"))):
            if held != (c.as_py(), d.as_py()):
                if held:
                    out.append((*held, sha.hexdigest()))
                held, sha = (c.as_py(), d.as_py()), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
        if out:
            yield _rows(out, [pa.int64()] * 2 + [pa.string()], [*AT, "ends_sha256"])
    if held:
        yield _rows([(*held, sha.hexdigest())], [pa.int64()] * 2 + [pa.string()], [*AT, "ends_sha256"])


def _rows(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes in which conversations (``member``) end."""
    n, order = shuffle_width(ends.sparkSession), [*AT, "member"]
    parts = settle(ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_pieces(IDS), "conv_id long, depth long, low long, ids string"), "pieces")
    return parts.repartition(n, *AT).sortWithinPartitions(*AT, "low").mapInArrow(_digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, opening=as_logged) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    convs, rows = rebuilt(turns, opening)
    convs = settle(convs, "sizes")
    hashes = {f"k{i}": F.xxhash64(F.lit(i), "depth", "a", "b") for i in (0, 1)}
    prefixes = bucketed(along(rows, hashes, F.bit_xor, False).select(*AT, "k0", "k1", "words"), "prefixes", AT)
    prefix = spark.table(prefixes)
    least = prefix.groupBy(*DIGEST).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    minima = bucketed(least, "minima", [*AT, "k0", "k1"])
    least = spark.table(minima)
    root = F.lit(convs.agg(F.min("conv_id")).first()[0]).cast("long")
    found = settle(first_owned(convs, root, prefix, least), "owned")

    # Where a chain hangs, or where a conversation without nodes of its own ends.
    above = found.where("f > 1").withColumn("depth", F.col("f") - 1).join(prefix.select(*AT, "k0", "k1"), AT)
    above = settle(above.select("conv_id", "n", "f", *DIGEST), "above")
    named = above.groupBy(*DIGEST).count().join(least.select(*DIGEST, F.col("conv_id").alias("up")), DIGEST)
    below = join_by_share(above, named, DIGEST, "count").select("conv_id", "n", "f", "up")
    first = found.where("f = 1").select("conv_id", "n", "f", root.alias("up"))
    top = found.where("f = 0").select("conv_id", "n", "f", F.lit(None).cast("long").alias("up"))
    hung = settle(below.unionByName(first).unionByName(top), "hung")
    chains = hung.where("f <= n")

    count = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("conv_id is not null")
    count = count.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = settle(least.select(*AT, "n_convs", "words").unionByName(count).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    for table in (prefixes, minima):
        drop_bucketed(spark, table)

    kids = chains.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("f") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    leaf = chains.select("conv_id", F.col("n").alias("depth")).join(kids, AT, "left").select("conv_id", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    total = chain_sums(chains.select("conv_id", "f", F.col("up").alias("ptr"), "up").join(own, "conv_id").join(leaf, "conv_id"), ["leaves", "saved"])

    zero = F.lit(0).cast("long")
    hanging = total.where("up is not null").select(F.col("up").alias("conv_id"), (F.col("f") - 1).alias("depth"), F.lit(1).cast("long").alias("kids"), "leaves", "saved", zero.alias("bottom"), F.lit(None).cast("long").alias("up"))
    bottom = chains.select("conv_id", F.col("n").alias("depth"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), F.lit(1).cast("long").alias("bottom"), F.lit(None).cast("long").alias("up"))
    tops = total.where("up is not null").select("conv_id", F.col("f").alias("depth"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), zero.alias("bottom"), "up")
    fact = hanging.unionByName(bottom).unionByName(tops).groupBy(*AT).agg(
        F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("from_below"), F.max("bottom").alias("bottom"), F.max("up").alias("up")
    )
    node = nodes.join(fact, AT, "left").select(
        *AT, "n_convs", "up", F.coalesce("kids", zero).alias("kids"), F.coalesce("bottom", zero).alias("bottom"),
        F.coalesce("leaves", zero).alias("leaves"), (F.col("saved") + F.coalesce("from_below", zero)).alias("saved"),
    )
    node = node.withColumn("leaves", F.col("leaves") + F.when((F.col("bottom") == 1) & (F.col("kids") == 0), 1).otherwise(0))
    node = along(node, {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")}, F.sum, True)
    owner = F.when(F.col("f") <= F.col("n"), F.col("conv_id")).otherwise(F.col("up"))
    ends = settle(hung.select(owner.alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member")), "ends")
    return (
        node.join(end_digests(ends), AT, "left")
        .withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")))
        .select(*AT, "parent_conv_id", "n_convs", (F.col("kids") + 1 - F.col("bottom")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    )
