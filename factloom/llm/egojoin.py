"""Embedding near-dedup: epsilon grid order join.

Unit vectors are projected on leading principal axes (fitted on a bounded sample; any
orthonormal axes give the same result) and sorted by label and grid cell, epsilon wide.
The sorted sequence is cut into blocks. Two blocks are joined only if their boxes on the
principal axes come within epsilon; inside, intervals are halved and skipped the same way
until they are small, then compared by matrix product in double precision.

Equal vectors of one label (by SHA-256 of their bytes) are one class with a count, so copies
aren't expanded. Neighbouring blocks meet in tiles of ``TILE`` by ``TILE`` pairs, so that a
block's vectors move once a tile. A tile returns each class's number of links and a spanning
forest of its links, not pairs. A cosine within rounding of the threshold is computed again
from the vectors themselves.

A null label links with nothing, nor do vectors that are null, zero, or hold null or
non-finite components, nor rows without vec_id (component_id null, kept true). Vectors of
different lengths don't link. Rows with one vec_id are vectors of their own that share a
node. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import components, join_by_share, settle, shuffle_width
from .grouping import key_runs

AXES, BLOCK, LEAF = 4, 1024, 64
#: Blocks a side of a tile, as a power of two.
TILE = 3


def _matrix(cells, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.as_buffer().to_pybytes() for c in cells), "<f8").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _valid(batches):
    for b in batches:
        out = []
        for label, v in zip(b.column("label"), b.column("embedding")):
            x = None
            if label.is_valid and v.is_valid and v.values is not None and v.values.null_count == 0 and len(v.values):
                a = v.values.to_numpy().astype("<f8")
                scale = np.abs(a).max()
                if np.isfinite(scale) and scale > 0:
                    # Scaled by a power of two where squares could leave the range, which changes no cosine.
                    x = (a if 1e-100 < scale < 1e100 else np.ldexp(a, -int(np.frexp(scale)[1]))).tobytes()
            out.append(x)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])


def principal_axes(sample: np.ndarray, axes: int = AXES) -> np.ndarray:
    """Columns are orthonormal directions of most variance."""
    centred = sample - sample.mean(axis=0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : min(axes, sample.shape[1])]


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """By its definition, each sum rounded once."""
    dot = lambda p, q: math.fsum((p * q).tolist())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def _apart(a_lo, a_hi, b_lo, b_hi, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a_lo - b_hi, b_lo - a_hi))
    return float((gap * gap).sum()) > eps * eps * (1 + 1e-9)


def _join(xa, ya, xb, yb, same: bool, least: float, eps: float, hit) -> None:
    """Recursive join of two intervals; hit(rows of a, rows of b) gets linked pairs."""

    def go(i, j, k, m):
        if _apart(ya[i:j].min(axis=0), ya[i:j].max(axis=0), yb[k:m].min(axis=0), yb[k:m].max(axis=0), eps):
            return
        if j - i <= LEAF and m - k <= LEAF:
            r, c = np.nonzero(xa[i:j] @ xb[k:m].T >= least)
            if len(r):
                hit(r + i, c + k)
            return
        if j - i >= m - k:
            h = (i + j) // 2
            go(i, h, k, m)
            go(h, j, k, m)
        else:
            h = (k + m) // 2
            go(i, j, k, h)
            go(i, j, h, m)

    def own(i, j):
        if j - i <= LEAF:
            r, c = np.nonzero(np.triu(xa[i:j] @ xa[i:j].T >= least, 1))
            if len(r):
                hit(r + i, c + i)
            return
        h = (i + j) // 2
        own(i, h)
        own(h, j)
        go(i, h, h, j)

    if same:
        own(0, len(xa))
    else:
        go(0, len(xa), 0, len(xb))


def self_join(vectors: DataFrame, least: float = 0.93, sample: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label)."""
    spark = vectors.sparkSession
    n = shuffle_width(spark)
    eps = float(np.sqrt(2 - 2 * least))
    label_type = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", "embedding").mapInArrow(_valid, f"vec_id long, label {label_type}, vec binary")
    rows = settle(rows.withColumn("key", F.unhex(F.sha2("vec", 256))), "vectors")
    good = rows.where("vec is not null and vec_id is not null")
    cls = good.groupBy("label", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min_by("vec", "vec_id").alias("vec"))
    cls = settle(cls.withColumn("dim", F.octet_length("vec") / 8).withColumn("dim", F.col("dim").cast("int")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    axes: dict[int, np.ndarray] = {}
    sizes = {r.dim: r["count"] for r in cls.groupBy("dim").count().collect()}
    for dim, total in sizes.items():
        unit = F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) / float(1 << 30)
        got = cls.where((F.col("dim") == dim) & (unit < sample / total)).select("vec").collect() or cls.where(F.col("dim") == dim).select("vec").limit(1).collect()
        axes[dim] = principal_axes(_unit(np.array([np.frombuffer(r.vec, "<f8") for r in got])))

    def project(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            y = np.zeros((b.num_rows, AXES))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                y[at, : axes[d].shape[1]] = _unit(_matrix(b.column("vec").take(pa.array(at)), d)) @ axes[d]
            cell = np.floor(y / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cell[:, k]) for k in range(AXES))], names=[*b.schema.names, *(f"c{k}" for k in range(AXES))])

    cells = [f"c{k}" for k in range(AXES)]
    schema = f"cid long, id long, n long, label {label_type}, dim int, vec binary, " + ", ".join(f"{c} int" for c in cells)
    grid = cls.select("cid", "id", "n", "label", "dim", "vec").mapInArrow(project, schema)
    order = ["label", "dim", *cells, "cid"]

    def cut(batches):
        held: list[pa.RecordBatch] = []

        def emit(part: pa.Table):
            d = part.column("dim")[0].as_py()
            x = _matrix(part.column("vec").combine_chunks(), d)
            y = np.zeros((len(x), AXES))
            y[:, : axes[d].shape[1]] = _unit(x) @ axes[d]
            ids = np.stack([part.column(c).to_numpy() for c in ("cid", "id", "n")], axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array([part.column("label")[0].as_py()], part.schema.field("label").type), pa.array([d], pa.int32()), pa.array([y.min(axis=0)], pa.list_(pa.float64())), pa.array([y.max(axis=0)], pa.list_(pa.float64())), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                names=["label", "dim", "lo", "hi", "ids", "x"],
            )

        def pieces(t: pa.Table, final: bool):
            labels, dims = t.column("label").to_pylist(), t.column("dim").to_pylist()
            i = 0
            while i < t.num_rows:
                j = i
                while j < t.num_rows and j - i < BLOCK and labels[j] == labels[i] and dims[j] == dims[i]:
                    j += 1
                if j == t.num_rows and j - i < BLOCK and not final:
                    break
                yield emit(t.slice(i, j - i))
                i = j
            held[:] = t.slice(i).to_batches() if i < t.num_rows else []

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) > BLOCK:
                yield from pieces(pa.Table.from_batches(held), False)
        if sum(x.num_rows for x in held):
            yield from pieces(pa.Table.from_batches(held), True)

    blocks = grid.repartitionByRange(n, *order).sortWithinPartitions(*order)
    blocks = blocks.mapInArrow(cut, f"label {label_type}, dim int, lo array<double>, hi array<double>, ids binary, x binary")
    blocks = settle(blocks.withColumn("bid", F.monotonically_increasing_id()), "blocks")
    box = blocks.select("bid", "label", "dim", "lo", "hi")
    cell = lambda c: F.floor(F.col(c)[0] / eps)
    a = box.select(F.col("bid").alias("a"), "label", "dim", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("cell"))
    b = box.select(F.col("bid").alias("b"), "label", "dim", F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    gap = F.aggregate(
        F.arrays_zip("alo", "ahi", "blo", "bhi"), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(F.lit(0.0), z["alo"] - z["bhi"], z["blo"] - z["ahi"]), F.lit(2.0))
    )
    pairs = a.join(b, ["label", "dim", "cell"]).where("a <= b").where(gap <= eps * eps * (1 + 1e-9)).select("a", "b").distinct()
    tile = pairs.groupBy(F.shiftright("a", TILE).alias("ta"), F.shiftright("b", TILE).alias("tb")).agg(F.collect_list(F.struct("a", "b")).alias("todo"))
    tile = settle(tile.select("todo").withColumn("tid", F.monotonically_increasing_id()), "tiles")
    both = F.array_distinct(F.flatten(F.transform("todo", lambda p: F.array(p["a"], p["b"]))))
    shipped = tile.select("tid", "todo", F.explode(both).alias("bid")).join(blocks.select("bid", "dim", "ids", "x"), "bid").select("tid", "bid", "todo", "dim", "ids", "x")

    def compare(batches):
        for t, at in key_runs(batches, ["tid"]):
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                part = t.slice(lo, hi - lo)
                bid, dim = part.column("bid").to_pylist(), part.column("dim").to_pylist()
                ids = {b: np.frombuffer(v.as_buffer(), np.int64).reshape(-1, 3) for b, v in zip(bid, part.column("ids"))}
                raw = {b: np.frombuffer(v.as_buffer(), "<f8").reshape(-1, d) for b, d, v in zip(bid, dim, part.column("x"))}
                x = {b: _unit(v) for b, v in raw.items()}
                y = {b: v @ axes[v.shape[1]] for b, v in x.items()}
                for p in part.column("todo")[0].as_py():
                    yield pair(p["a"], p["b"], ids, raw, x, y)

    def pair(a, b, ids, raw, x, y):
        same = a == b
        who = ids[a] if same else np.concatenate((ids[a], ids[b]))
        links, parent, shift, edges = np.zeros(len(who), np.int64), list(range(len(who))), 0 if same else len(ids[a]), []

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def hit(r, c):
            near = np.einsum("ij,ij->i", x[a][r], x[b][c])
            # Within rounding of the threshold the cosine is taken by its definition, with exact sums.
            sure = np.array([abs(s - least) > 1e-12 or _cosine(raw[a][i], raw[b][j]) >= least for s, i, j in zip(near.tolist(), r.tolist(), c.tolist())], bool)
            r, c = r[sure], c[sure] + shift
            np.add.at(links, r, who[c, 2])
            np.add.at(links, c, who[r, 2])
            for i, j in zip(r.tolist(), c.tolist()):
                p, q = root(i), root(j)
                if p != q:
                    parent[q] = p
                    edges.append((i, j))

        _join(x[a], y[a], x[b], y[b], same, least - 1e-12, eps, hit)
        some = np.flatnonzero(links)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(who[some, 0], who[e[:, 0], 0])), pa.array(np.append(links[some], np.zeros(len(e), np.int64))), pa.array([None] * len(some) + who[e[:, 0], 1].tolist(), pa.int64()), pa.array([None] * len(some) + who[e[:, 1], 1].tolist(), pa.int64())],
            names=["cid", "links", "u", "v"],
        )

    found = shipped.repartition(n, "tid").sortWithinPartitions("tid", "bid").mapInArrow(compare, "cid long, links long, u long, v long")
    found = settle(found, "links")
    count = found.groupBy("cid").agg(F.sum("links").alias("links"))
    held = join_by_share(good.select("vec_id", "label", "key"), cls.select("label", "key", "id", "n", "cid", F.col("n").alias("rows")), ["label", "key"], "rows")
    alone = rows.where("vec_id is not null and vec is null").select("vec_id", *[F.lit(None).cast("long").alias(c) for c in ("id", "n", "cid")])
    own = held.select("vec_id", "id", "n", "cid").unionByName(alone).join(count, "cid", "left")
    copies = own.where("id <> vec_id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    label = components(found.where("u is not null").select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(copies)).withColumnRenamed("node", "vec_id")
    own = own.join(label, "vec_id", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id")
    )
    own = own.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    none = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return own.unionByName(none)
