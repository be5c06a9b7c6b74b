"""Chat formatting: logged snapshots collapse into maximal conversations, which are rendered.

Turns of a conversation are ordered by turn (null first), role and text. A prefix of i turns
has a rolling hash, the running sum over its turns of three 40-bit hashes of (position,
role, text). A conversation whose whole hash is a proper prefix of another's is a snapshot
and goes, by an anti-join; of equal conversations the smallest conv_id stays. Every step
is a DataFrame operation.

Null roles and texts count as empty; very long ones are rendered whole. Rows without conv_id belong to no conversation and
are left out. Repeated rows are turns of their own. Sums hold for 8 million turns. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import settle


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, at (turns in the prefix), last (is it the whole), h (the prefix's hashes)."""
    t = _plain(turns)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("at", F.row_number().over(order)).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    h = [F.sum(F.shiftright(F.xxhash64(F.lit(k), "at", "role", "text"), 24)).over(run).alias(f"h{k}") for k in range(3)]
    return t.select("conv_id", "at", "last", *h)


def _plain(turns: DataFrame) -> DataFrame:
    return turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that stay."""
    p = settle(prefixes(turns), "prefixes")
    key = ["at", "h0", "h1", "h2"]
    whole = p.where("last").groupBy(key).agg(F.min("conv_id").alias("conv_id"))
    proper = p.where("not last").select(key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, chat of maximal conversations."""
    kept = _plain(turns).join(maximal(turns), "conv_id", "left_semi")
    c = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    line = lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n"))
    return c.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", line), "").alias("chat"))
