"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine c are at squared distance 2 - 2c. After a rotation the coordinates are split into blocks; if two vectors
are within squared distance D, then in some block they are within D times the block's share of the dimensions. Each block is
joined on its own under that budget: space is parted into boxes over all coordinates of the block, a vector lives in one box and visits those
within the budget of it, and meets who lives there. Whatever passes a block is verified in double precision.

How much boxes save depends on the data. At cosine 0.9 in 64 dimensions and 4 blocks the budget's radius is 1.8 standard deviations
of a coordinate if vectors lie evenly in all directions; then a vector visits most boxes, whatever their shape, and the work stays a
share of all pairs. Vectors in clusters visit few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, hot_join
from .graph import connected_components, local_forest

SEED = 7
SLACK = 1e-9  # of a budget, for rounding
#: Least and most rows of a chunk; a quarter of the rows between them, so that copies of a vector are some twenty until 130,000 distinct ones, and
#: a task holds two chunks of some 50 MB at most.
CHUNK = (4096, 32768)


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows of x under random signs and a fast Walsh-Hadamard transform, zeros appended to a power of two.

    Each output is made by the same additions whatever rows stand beside it, so tasks agree to the last bit.
    """
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x * np.random.default_rng(SEED).choice([-1.0, 1.0], x.shape[1])
    half = 1
    while half < size:
        y = y.reshape(len(x), -1, 2, half)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), size)
        half *= 2
    return y / np.sqrt(size)


def blocks_of(size: int, blocks: int) -> list[slice]:
    """Ranges of equal width (the last may be narrower) over the rotated coordinates."""
    width = -(-size // min(blocks, size))
    return [slice(a, min(size, a + width)) for a in range(0, size, width)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def budgets(size: int, parts: list[slice], cosine: float) -> np.ndarray:
    return np.array([(2 - 2 * cosine) * (p.stop - p.start) / size * (1 + SLACK) + SLACK for p in parts])


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null, NaN or infinite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def links_within(table: pa.Table, cosine: float, blocks: int, rows: int = 1024) -> pa.Table:
    """The verified links of one unit (left rows against right rows of one block): (id, n, peer).

    n counts the copies that an id is linked with, in rows without a peer; rows with one make up a forest of the links. A link that
    several blocks find is counted by the first of them alone.
    """
    ids, weight = table["id"].to_numpy(), table["n"].to_numpy()
    block, side = int(table["block"][0].as_py()), table["side"].to_numpy()
    vectors = table["vec"].combine_chunks()
    x = unit(np.asarray(vectors.flatten(), np.float64).reshape(len(ids), -1))
    y = rotated(x)
    parts = blocks_of(y.shape[1], blocks)
    most = budgets(y.shape[1], parts, cosine)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a chunk against itself
    same = bool((side == 2).all())
    # one product gives minus half the squared distances of the block; single precision, with room for its rounding
    own = y[:, parts[block]]
    half, one = np.einsum("ij,ij->i", own, own)[:, None] / 2, np.ones((len(own), 1))
    here, there = np.hstack([own, -half, one]).astype(np.float32), np.hstack([own, one, -half]).astype(np.float32)
    least = np.float32(-most[block] / 2 - 1e-5)
    counts, a_all, b_all = np.zeros(len(ids), np.int64), [], []
    for i in range(0, len(left), rows):
        for j in range(i if same else 0, len(right), rows):
            p, q = left[i : i + rows], right[j : j + rows]
            found = np.flatnonzero(here[p] @ there[q].T >= least)
            a, b = p[found // len(q)], q[found % len(q)]
            if same:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 100_000):
                u, v = a[k : k + 100_000], b[k : k + 100_000]
                ok = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                u, v = u[ok], v[ok]
                passed = np.stack([((y[u, s] - y[v, s]) ** 2).sum(1) <= m for s, m in zip(parts, most, strict=True)])
                first = passed.argmax(0) == block
                u, v = u[first], v[first]
                counts += np.bincount(u, weight[v], len(ids)).astype(np.int64) + np.bincount(v, weight[u], len(ids)).astype(np.int64)
                if len(u):
                    a_all, b_all = [[z] for z in local_forest(np.concatenate([*a_all, u]), np.concatenate([*b_all, v]))]
    on = np.flatnonzero(counts)
    src, dst = (a_all[0], b_all[0]) if a_all else (np.empty(0, np.int64), np.empty(0, np.int64))
    peer = pa.array(np.concatenate([np.zeros(len(on), np.int64), ids[dst]]), mask=np.arange(len(on) + len(src)) < len(on))
    return pa.table({"id": np.concatenate([ids[on], ids[src]]), "n": np.concatenate([counts[on], np.zeros(len(src), np.int64)]), "peer": peer})


class Boxes:
    """Boxes that part a block's space, each at the median of the widest coordinate of the fullest one so far."""

    def __init__(self, sample: np.ndarray, most: int):
        lo, hi, rows = [np.full(sample.shape[1], -np.inf)], [np.full(sample.shape[1], np.inf)], [np.arange(len(sample))]
        while len(rows) < most:
            k = max(range(len(rows)), key=lambda i: len(rows[i]))
            own = sample[rows[k]]
            if len(own) < 2 or not (spread := np.ptp(own, axis=0)).max():
                break
            d = int(spread.argmax())
            at = float(np.median(own[:, d]))
            left = own[:, d] < at
            if not left.any():  # most values are the least one
                at = float(own[:, d][own[:, d] > at].min())
                left = own[:, d] < at
            lo.append(lo[k].copy())
            hi.append(hi[k].copy())
            hi[k][d] = lo[-1][d] = at
            rows[k], right = rows[k][left], rows[k][~left]
            rows.append(right)
        self.lo, self.hi = np.stack(lo), np.stack(hi)

    def off(self, y: np.ndarray) -> np.ndarray:
        """[row, box] squared distances."""
        out = np.zeros((len(y), len(self.lo)))
        for d in range(y.shape[1]):
            x = y[:, d, None]
            out += np.maximum(np.maximum(self.lo[:, d] - x, x - self.hi[:, d]), 0) ** 2
        return out

    def homes(self, y: np.ndarray) -> np.ndarray:
        """The first box that holds each row."""
        return (self.off(y) == 0).argmax(1)

    def bounds(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(box, least, most): of each box that is home to some row, the least and the most of their coordinates."""
        home = self.homes(y)
        order = np.argsort(home, kind="stable")
        box, at = np.unique(home[order], return_index=True)
        return box, np.minimum.reduceat(y[order], at), np.maximum.reduceat(y[order], at)

    def shrunk(self, box: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Boxes:
        """Boxes that just hold their residents; one without any is out of everybody's reach."""
        out = Boxes.__new__(Boxes)
        out.lo, out.hi = np.full_like(self.lo, np.inf), np.full_like(self.hi, np.inf)
        out.lo[box], out.hi[box] = lo, hi
        return out

    def visits(self, y: np.ndarray, home: np.ndarray, budget: float) -> np.ndarray:
        """[row, box] whether a row visits it: boxes after its home within the budget."""
        return (self.off(y) <= budget) & (np.arange(len(self.lo)) > home[:, None])


def by_size(vecs: pd.Series, rows: int = 1000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which, rotated unit vectors) of vectors of one length each, some ``rows`` at a time."""
    sizes = vecs.map(len).to_numpy()
    for size in np.unique(sizes):
        whole = np.flatnonzero(sizes == size)
        for at in np.array_split(whole, max(1, len(whole) // rows)):
            yield int(size), at, rotated(unit(np.stack(vecs.iloc[at]).astype(np.float64)))


def fitted(vectors: DataFrame, rows: int, cosine: float, blocks: int, chunk: int, sample: int, most: int) -> dict[int, list[Boxes]]:
    """Boxes for each block of each length of vectors, as many as make homes of about ``chunk`` rows, ``most`` at most.

    Fitted on about ``sample`` vectors chosen by a hash: a documented bound. Every vector is placed, in whatever boxes these give.
    """
    share = min(1.0, sample / max(rows, 1))
    chosen = vectors.where(F.xxhash64("id", F.lit("boxes")) / F.lit(2.0**64) + 0.5 <= share).select("vec").toPandas().vec
    out = {}
    sizes = chosen.map(len).to_numpy()
    for size in np.unique(sizes):
        y = rotated(unit(np.stack(chosen[sizes == size]).astype(np.float64)))
        n = int(np.clip(-(-rows * (sizes == size).mean() // chunk), 1, most))
        out[int(size)] = [Boxes(y[:, p], n) for p in blocks_of(y.shape[1], blocks)]
    return out


def near_vectors(vectors: DataFrame, cosine: float, blocks: int, chunk: int, sample: int = 20_000, most_boxes: int = 4096) -> DataFrame:
    """(id, n, peer) over distinct vectors (id, n copies, vec), as of :func:`links_within`.

    Two vectors within the budget of a block meet in the later of their homes: one lives there, the other visits it or lives there too. Who
    lives in a box and who visits it are cut into chunks of ``chunk`` rows, and each pair of chunks is a unit of its own, so a task holds two
    chunks however full a box is.
    """
    boxes = fitted(vectors, vectors.count(), cosine, blocks, chunk, sample, most_boxes)

    def of(size: int, width: int) -> list[tuple[slice, Boxes]]:
        parts = blocks_of(width, blocks)
        return list(zip(parts, boxes.get(size) or [Boxes(np.empty((0, p.stop - p.start)), 1) for p in parts], strict=True))

    def extents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for size, _, y in by_size(rows.vec, 100_000):
                for b, (p, own) in enumerate(of(size, y.shape[1])):
                    box, lo, hi = own.bounds(y[:, p])
                    n, d = lo.shape
                    yield pd.DataFrame({"size": size, "block": b, "box": np.repeat(box, d), "d": np.tile(np.arange(d), n), "lo": lo.ravel(), "hi": hi.ravel()})

    # boxes are as tight as all their residents allow; a row a box and coordinate, at most ``most_boxes`` times the length of a vector
    found = vectors.select("vec").mapInPandas(extents, "size int, block int, box int, d int, lo double, hi double")
    found = found.groupBy("size", "block", "box", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().sort_values(["box", "d"])
    tight = {}
    for (size, block), rows in found.groupby(["size", "block"]):
        width = int(rows.d.max()) + 1
        start = of(int(size), 1 << max(0, (int(size) - 1).bit_length()))[int(block)][1]
        tight[int(size), int(block)] = start.shrunk(rows.box.to_numpy()[::width], rows.lo.to_numpy().reshape(-1, width), rows.hi.to_numpy().reshape(-1, width))

    @F.pandas_udf("array<struct<block int, box int, home boolean>>")
    def places(vecs: pd.Series) -> pd.Series:
        out: list = [[] for _ in vecs]
        for size, at, y in by_size(vecs):
            for b, ((p, own), most) in enumerate(zip(of(size, y.shape[1]), budgets(y.shape[1], blocks_of(y.shape[1], blocks), cosine), strict=True)):
                home = own.homes(y[:, p])
                calls = tight[size, b].visits(y[:, p], home, most)
                for k, i in enumerate(at):
                    out[i] += [{"block": b, "box": int(home[k]), "home": True}, *({"block": b, "box": int(x), "home": False} for x in np.flatnonzero(calls[k]))]
        return pd.Series(out)

    placed = cut(vectors.select("id", F.size("vec").alias("size"), F.inline(places("vec"))))
    key = ["size", "block", "box"]
    count = lambda c: F.ceil(F.count(F.when(c, 1)) / chunk).cast("int")
    sizes = placed.groupBy(*key).agg(count(F.col("home")).alias("homes"), count(~F.col("home")).alias("guests"))
    rows = placed.join(bounded(sizes, sizes.count()), key).where("homes > 0")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    # parts of a box: its homes from 0, its guests from -1 down; a unit is a part of homes and another part, the side tells which one a row is in
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    unit_of = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    among = F.transform(upto(F.col("homes")), lambda j: F.when(j == F.col("own"), unit_of(j, j, 2)).when(F.col("own") < j, unit_of(F.col("own"), j, 0)).otherwise(unit_of(j, F.col("own"), 1)))
    hosts = F.when(F.col("guests") > 0, F.transform(upto(F.greatest(F.col("guests"), F.lit(1))), lambda j: unit_of(F.col("own"), -1 - j, 0))).otherwise(F.array().cast("array<struct<a int, b int, side int>>"))
    calls = F.transform(upto(F.col("homes")), lambda j: unit_of(j, -1 - F.col("own"), 1))
    units = rows.withColumn("own", own).select("id", *key, F.inline(F.when(F.col("home"), F.concat(among, hosts)).otherwise(calls)))
    units = units.join(vectors.select("id", "n", "vec"), "id").select(F.hash(*key, "a", "b").alias("h"), *key, "a", "b", "side", "id", "n", "vec")

    def linked(table: pa.Table) -> pa.Table:
        return links_within(table, cosine, blocks)

    return units.groupBy("h", *key, "a", "b").applyInArrow(linked, "id long, n long, peer long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, blocks: int = 4, chunk: int | None = None) -> DataFrame:
    """For each row: id, n_links (other rows linked directly), component_id (smallest id reachable) and kept (it is its own component).

    Rows link at the given cosine or more, measured in double precision. Null and zero vectors, and vectors with null or non-finite
    components, link with nothing; vectors of different lengths do not link. Equal vectors are compared once, as one, and count
    by their number. Repeated rows are rows of their own. Vectors travel once to each unit they take part in.
    """
    own = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"))
    own = own.withColumn("vec", F.when(usable(F.col("vec")), F.col("vec")))
    own = own.withColumn("h", F.concat_ws(":", F.xxhash64("vec"), F.xxhash64(F.lit("second"), "vec")))
    classes = own.where("vec is not null").groupBy("h", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    chunk = chunk or int(np.clip(classes.count() / 4, *CHUNK))
    found = cut(near_vectors(classes.select("id", "n", "vec"), cosine, blocks, chunk))
    degree = found.where("peer is null").groupBy("id").agg(F.sum("n").alias("linked"))
    joined = connected_components(found.where("peer is not null"), "id", "peer")
    named = classes.select("h", "id", "least", "n").join(degree, "id", "left").join(joined, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component")
    named = cut(named)
    roots = cut(named.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n_classes")))
    named = hot_join(named, roots, "root", "n_classes").select("h", "n", F.coalesce("linked", F.lit(0)).alias("linked"), "component")
    # equal hashes of 128 bits are equal vectors: classes were formed by the vectors themselves, and a class is met by its hash
    members = hot_join(own.where("vec is not null").select("id", "h"), cut(named), "h", "n")
    members = members.select("id", (F.col("n") - 1 + F.col("linked")).cast("long").alias("n_links"), "component")
    alone = own.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = members.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
