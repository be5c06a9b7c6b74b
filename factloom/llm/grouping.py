"""Connecting the members of groups of any size, in tasks of bounded size.

A group is cut into blocks of at most about ``block`` members by a hash of the member.
Round one connects members inside each block. Where that leaves a group of several blocks
in more than one component, round two compares every member outside the group's largest
component with every member of another component, again block by block. A pair in one
component needs no comparison, so all connections are found, and a large group of
similar members costs little more than one pass over it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import components, settle, shuffle_width

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with their bounds, from batches sorted by integer ``keys``; one group is held over at most."""
    carry: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if carry:
            last = carry[-1]
            change[0] = any(last.column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys)
        else:
            change[0] = True
        at = np.flatnonzero(change)
        if not len(at):
            carry.append(b)
            continue
        if carry and at[0] == 0 and len(at) == 1 or not carry and len(at) == 1:
            if carry:
                yield _whole(carry, keys)
            carry = [b]
            continue
        done = carry + [b.slice(0, int(at[-1]))]
        yield _whole(done, keys)
        carry = [b.slice(int(at[-1]))]
    if carry:
        yield _whole(carry, keys)


def _whole(parts: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches([p for p in parts if p.num_rows]).combine_chunks()
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for k in keys:
        c = t.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return t, np.append(np.flatnonzero(change), t.num_rows)


def _runs(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    n = shuffle_width(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(fn, schema)


def link_groups(
    members: DataFrame, payload: list[str], find: Callable[[pa.Table, np.ndarray | None], list[tuple[int, int]]], block: int, name: str
) -> DataFrame:
    """edges(a, b) that connect exactly what all comparisons within the groups would connect.

    ``members`` has group (long), id (long) and the payload. ``find(rows, side)`` gets one
    block (side None: all pairs) or the rows of two (side True marks the left ones: left
    against right only) and returns linked pairs that span its components.
    """

    def inside(batches):
        for table, at in key_runs(batches, ["grp", "blk"]):
            yield from _emit(find_each(table, at, None))

    def across(batches):
        for table, at in key_runs(batches, ["grp", "blk", "xblk"]):
            yield from _emit(find_each(table, at, "is_left"))

    def find_each(table, at, side):
        out: list[tuple[int, int]] = []
        bulk = getattr(find, "bulk", None)
        if side is None and bulk is not None:
            return bulk(table, at)
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo > 1:
                part = table.slice(lo, hi - lo)
                left = part.column(side).to_numpy() if side else None
                if left is None or 0 < left.sum() < len(left):
                    out += find(part, left)
        return out

    size = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    m = members.join(size, "group").select(
        F.col("group").alias("grp"),
        F.pmod(F.xxhash64("id", "group"), F.ceil(F.col("n") / F.lit(float(block)))).cast("int").alias("blk"),
        F.ceil(F.col("n") / F.lit(float(block))).cast("int").alias("nblk"),
        "id",
        *payload,
    )
    m = settle(m, f"{name}-members")
    first = settle(_runs(m.select("grp", "blk", "id", *payload), ["grp", "blk"], inside, "a long, b long"), f"{name}-inside")
    wide = m.where("nblk > 1")
    if wide.limit(1).count() == 0:
        return first
    label = components(first)
    wide = wide.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    wide = settle(wide, f"{name}-wide")
    count = wide.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    top = count.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("n").alias("all"))
    top = top.where("comps > 1").select("grp", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / F.lit(float(block))).cast("int").alias("nx"))
    rest = wide.join(top, "grp")
    left = rest.where("comp <> main").withColumn("xblk", F.pmod(F.xxhash64("id", "grp", F.lit(1)), F.col("nx")).cast("int"))
    left = left.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nblk") - 1))).withColumn("is_left", F.lit(True))
    right = rest.withColumn("xblk", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("is_left", F.lit(False))
    cols = ["grp", "blk", "xblk", "is_left", "id", "comp", *payload]
    second = _runs(left.select(cols).unionByName(right.select(cols)), ["grp", "blk", "xblk"], across, "a long, b long")
    return first.unionByName(settle(second, f"{name}-across"))


def _emit(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        a = np.array(pairs, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], schema=EDGES)


def fixed_binary(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a binary column that all hold ``width`` bytes, as a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(c, pa.ChunkedArray):
        c = c.chunk(0)
    off = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset]
    return np.frombuffer(c.buffers()[2], np.uint8, count=len(c) * width, offset=int(off)).reshape(len(c), width)
