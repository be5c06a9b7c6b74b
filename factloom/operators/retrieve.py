"""Hybrid retrieval: vector top-k, symbolic look-ups, merging, reranking, packaging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rerank_score


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _blocks(key: str, size: int):
    """Arrow batches to rows of (ids, vectors as one run of doubles, dim); null, zero and non-finite vectors are left out."""

    def fn(batches):
        for b in batches:
            held: dict[int, tuple[list, list]] = {}
            for i, v in zip(b.column(key).to_pylist(), b.column("embedding")):
                if v.is_valid and v.values is not None and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(float)
                    n = np.sqrt((x * x).sum())
                    if np.isfinite(n) and n > 0:
                        ids, rows = held.setdefault(len(x), ([], []))
                        ids.append(i)
                        rows.append(x / n)
            for dim, (ids, rows) in held.items():
                for at in range(0, len(ids), size):
                    part = np.array(rows[at : at + size], "<f8")
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at : at + size]], pa.list_(pa.int64())), pa.array([part.tobytes()], pa.binary()), pa.array([dim], pa.int32())], names=["ids", "x", "dim"])

    return fn


def _nearest(k: int):
    def fn(batches):
        for b in batches:
            for vi, vx, qi, qx, dim in zip(*(b.column(c) for c in ("ids", "x", "q_ids", "q_x", "dim"))):
                d = dim.as_py()
                v, q = (np.frombuffer(c.as_buffer(), "<f8").reshape(-1, d) for c in (vx, qx))
                ids, asked = vi.values.to_numpy(), qi.values.to_numpy()
                s = np.round(q @ v.T, 6)
                out: list[list] = [[], [], []]
                for r in range(len(asked)):
                    best = np.lexsort((ids, -s[r]))[:k]
                    for c, x in zip(out, (np.full(len(best), asked[r]), ids[best], s[r, best])):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "similarity"])

    return fn


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """Rows of ``vectors`` with query_id, similarity and rank: the k nearest by cosine, ties by vec_id.

    Vectors and queries meet in blocks by one matrix product each, which leaves k rows a query
    and block to be ranked. Neither side is broadcast by hand, nor held whole anywhere.
    """
    shape = "ids array<long>, x binary, dim int"
    v = vectors.select("vec_id", "embedding").mapInArrow(_blocks("vec_id", block), shape)
    q = queries.select("query_id", "embedding").mapInArrow(_blocks("query_id", block), shape).select(F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), "dim")
    near = v.join(q, "dim").select("ids", "x", "q_ids", "q_x", "dim").mapInArrow(_nearest(k), "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    hits = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.join(vectors.drop("embedding"), "vec_id")


def merge_hits(symbolic: DataFrame, semantic: DataFrame) -> DataFrame:
    """Full outer join on (query_id, memory_id); symbolic fields win except type and status."""
    a, b = symbolic.alias("a"), semantic.alias("b")
    j = a.join(b, ["query_id", "memory_id"], "full_outer")
    first = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    last = lambda c: F.coalesce(f"b.{c}", f"a.{c}").alias(c)
    return j.select("query_id", "memory_id", first("similarity"), first("confidence"), last("status"), F.col("a.memory_id").isNotNull().alias("symbolic"))


def rerank(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Hits by falling score, ties by memory_id, with their position."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    return hits.withColumn("score", F.round(rerank_score(weights), 6)).withColumn("position", F.row_number().over(w))


def package(ranked: DataFrame, most: int = 3) -> DataFrame:
    """Per query: the first ``most`` supporting ids (accepted, not contradicted), confidence of the first, conflict ids."""
    good = (F.col("status") == "accepted") & (F.col("contradiction_penalty") == 0)
    place = F.row_number().over(Window.partitionBy("query_id", "good").orderBy("position"))
    rows = ranked.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("place", place).where(~F.col("good") | (F.col("place") <= most))
    rows = rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("good"), F.struct("position", "memory_id", "confidence")))).alias("s"),
        F.sort_array(F.collect_set(F.when(~F.col("good"), F.col("memory_id")))).alias("conflicts"),
    )
    ids = F.transform("s", lambda x: x["memory_id"])
    return rows.select(
        "query_id", F.array_join(ids.cast("array<string>"), ",").alias("supporting"), F.get("s", F.lit(0))["confidence"].alias("confidence"), F.array_join(F.col("conflicts").cast("array<string>"), ",").alias("conflicts")
    )


def neighbours(edges: DataFrame, predicate: str, by: str) -> DataFrame:
    """entity, answer: what stands at the other end of a predicate's edges, ``by`` subject_id or object_id."""
    other = "object_id" if by == "subject_id" else "subject_id"
    return edges.where(F.col("predicate") == predicate).select(F.col(by).alias("entity"), F.col(other).alias("answer")).distinct()


def near_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id) of one type whose token sets contain one another; found by an equality join on a token.

    ``tokens`` are sorted distinct arrays. A pair in which one set holds the other shares the
    smaller set's first token, so each name is looked up by its first and listed by all.
    """
    a = left.select(F.col("id").alias("l_id"), "entity_type", F.col("tokens").alias("lt"))
    b = right.select(F.col("id").alias("r_id"), "entity_type", F.col("tokens").alias("rt"))
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    one = a.withColumn("t", F.get("lt", F.lit(0))).join(b.withColumn("t", F.explode("rt")), ["entity_type", "t"]).where(inside("lt", "rt"))
    two = a.withColumn("t", F.explode("lt")).join(b.withColumn("t", F.get("rt", F.lit(0))), ["entity_type", "t"]).where(inside("rt", "lt"))
    return one.select("l_id", "r_id").unionByName(two.select("l_id", "r_id")).where("l_id <> r_id").distinct()


def near_classes(names: DataFrame) -> DataFrame:
    """(l_id, r_id, part) of names(id, entity_type, tokens): what ``near_names`` links, without copies multiplied.

    Names of one type and token set are a class, called by its smallest id; a class's members are all
    near each other. ``member`` rows give each id its class, ``pair`` rows the classes that are near: two
    different ids are near if they are of one class or of two classes paired. Names without tokens are near nothing.
    """
    some = names.where(F.size("tokens") > 0)
    classes = some.groupBy("entity_type", "tokens").agg(F.min("id").alias("class"))
    one = classes.withColumnRenamed("class", "id")
    members = some.join(classes, ["entity_type", "tokens"]).select(F.col("class").alias("l_id"), F.col("id").alias("r_id"), F.lit("member").alias("part"))
    return near_names(one, one).withColumn("part", F.lit("pair")).unionByName(members)
