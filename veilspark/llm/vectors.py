"""Operator 10, embedding near-dedup with randomised-rotation binary codes.

A seeded random rotation is applied to each unit vector o; the signs of the rotated components are its code. Stored beside
it is the correction factor f = <o, code / sqrt(dim)>. For a rotated query vector q, <q, code / sqrt(dim)> / f estimates
<o, q> without bias, and the error is within eps * sqrt((1 - f^2) / f^2 / (dim - 1)) with a probability that eps sets.
Pairs whose upper bound is below the threshold are given up; every other pair is recomputed exactly, in double precision.

Which pairs are compared: equal vectors are one vector with a number of copies. `tables` groups of code bits, each of
further seeded projections, deal the vectors into buckets; pairs that meet in any bucket are compared, once, in the first
table where they meet. The number of bits grows with the logarithm of the number of vectors, so buckets keep their size.
Two vectors at the threshold meet in a table with probability (1 - arccos(0.95) / pi) ^ bits; the number of tables is
chosen for a recall of at least `recall` at the threshold and more above it. Buckets with more than `tile` vectors are cut
into tiles, and every pair of tiles is a task's work of its own; none is capped. Vectors of all lengths go through the
same jobs: the length is part of a bucket's key, and tables and bits are chosen for each length.

Only links that join components within a tile and counts of links leave a tile, never all pairs of a group.
Results: vectors that are null, zero, or hold null or non-finite components, have no link; so have vectors of a length
that no other has. Repeated rows are separate vectors; repeated ids are separate vectors that share an id.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import lean
from veilspark.llm.components import components
from veilspark.llm.scratch import kept

TILE = 2048


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Rows of rotations, as many as all tables need: the directions whose signs are bucket bits."""
    need = -(-tables * bits // dim)
    return np.concatenate([rotation(dim, seed + 1 + i) for i in range(need)])[: tables * bits]


def plan(count: int, threshold: float, recall: float, aim: int = 24) -> tuple[int, int]:
    """(tables, bits) for count vectors: about `aim` random vectors in a bucket, and the recall at the threshold."""
    bits = max(1, math.ceil(math.log2(max(2, count) / aim)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1, bits


def keys_of(x: np.ndarray, p: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Bucket of each vector in each table."""
    signs = (x @ p.T >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


class Tile:
    """Links among vectors, with bounds from binary codes."""

    def __init__(self, dim: int, threshold: float, eps: float, seed: int):
        self.turn, self.threshold, self.eps, self.dim = rotation(dim, seed), threshold, eps, dim

    def compare(self, a: dict, b: dict, table: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of linked vectors; a and b: unit (vectors), rotated, code, factor, keys."""
        est = (a["rotated"] @ b["code"].T) / b["factor"]
        bound = self.eps * np.sqrt(np.maximum(0, 1 - b["factor"] ** 2) / b["factor"] ** 2 / max(1, self.dim - 1))
        maybe = est + bound >= self.threshold - 1e-6
        if same:
            maybe &= np.tri(len(maybe), k=-1, dtype=bool).T
        i, j = np.nonzero(maybe)
        for t in range(table):  # pairs that met before
            new = a["keys"][i, t] != b["keys"][j, t]
            i, j = i[new], j[new]
        keep = []
        for s in range(0, len(i), 65536):
            dot = np.einsum("nd,nd->n", a["unit"][i[s : s + 65536]], b["unit"][j[s : s + 65536]])
            keep.append(dot >= self.threshold)
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return i[keep], j[keep]

    def coded(self, unit: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """What is stored of each vector: its packed code and its correction factor."""
        rotated = (unit @ self.turn.T).astype(np.float32)
        factor = np.abs(rotated).sum(1) / np.float32(math.sqrt(self.dim))  # the code has the signs of the components
        return [x.tobytes() for x in np.packbits(rotated >= 0, axis=1)], np.maximum(factor, 1e-6).astype(np.float32)

    def prepared(self, unit: np.ndarray, keys: np.ndarray, codes: list[bytes], factor: np.ndarray) -> dict:
        bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, count=self.dim)
        code = (2 * bits.astype(np.float32) - 1) / np.float32(math.sqrt(self.dim))
        return {"unit": unit, "rotated": (unit @ self.turn.T).astype(np.float32), "code": code, "factor": factor.astype(np.float32), "keys": keys}


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same nodes as all links i, j do: each node with the first of its component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    at = np.flatnonzero(root != np.arange(n))
    return list(zip(at.tolist(), root[at].tolist(), strict=True))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, eps: float = 3.5, seed: int = 11, tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    own = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("e"))
    # Negative zero equals zero; equal vectors must have equal arrays.
    own = own.withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))
    big = F.aggregate("e", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    fine = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("e") > 0) & (big > 0), F.lit(False))
    own = kept(own.select("vec_id", F.when(fine, F.col("e")).alias("e")), "vectors")
    distinct = own.filter("e is not null").groupBy("e").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = kept(distinct.withColumn("rid", F.monotonically_increasing_id()), "distinct")
    # Two numbers for each length; k lengths need k * k / 2 components at least, so there are few of them.
    sizes = distinct.groupBy(F.size("e").alias("d")).count().filter("count > 1").collect()
    plans = {r["d"]: plan(r["count"], threshold, recall) for r in sizes}
    if plans:
        found = kept(tile_links(distinct, plans, threshold, eps, seed, tile), "links")
    else:
        found = spark.createDataFrame([], "u long, v long, more long")
    counts = found.filter("more is not null").groupBy("u").agg(F.sum("more").alias("more"))
    groups = components(found.filter("v is not null").select("u", "v"))
    named = distinct.join(groups, distinct["rid"] == groups["node"], "left").drop("node").join(counts, distinct["rid"] == counts["u"], "left").drop("u")
    named = kept(named.select("e", "rid", "least", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("c")), "named")
    least = kept(named.groupBy("c").agg(F.min("least").alias("component_id")), "least")
    named = kept(named.join(least, "c").select("e", "n_links", "component_id"), "result")
    linked = own.filter("e is not null").join(named, "e").select("vec_id", "n_links", "component_id")
    alone = own.filter("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def tile_links(rows: DataFrame, plans: dict[int, tuple[int, int]], threshold: float, eps: float, seed: int, tile: int) -> DataFrame:
    """(u, v, more): links that join components (v set), and link counts of vectors (more set, weighted by copies).

    plans: (tables, bits) of each length; vectors of other lengths are left out.
    """
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(plans)

    def keyed(batches):
        last, turned, own_tile = None, None, None
        for pdf in batches:
            for dim, own in pdf.groupby("d", sort=True):
                if dim not in held.value:
                    continue
                tables, bits = held.value[dim]
                if dim != last:  # rows come by length
                    last, turned, own_tile = dim, planes(dim, tables, bits, seed), Tile(dim, threshold, eps, seed)
                x = np.stack(own["e"].to_numpy())
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                k = keys_of(x, turned, tables, bits)
                code, factor = own_tile.coded(x)
                yield pd.DataFrame({"d": own["d"], "rid": own["rid"], "copies": own["copies"], "unit": list(x), "keys": list(k), "code": code, "factor": factor})

    sized = rows.select(F.size("e").alias("d"), "rid", "copies", "e").sortWithinPartitions("d")
    coded = kept(sized.mapInPandas(lean(keyed), "d int, rid long, copies long, unit array<double>, keys array<long>, code binary, factor float"), "coded")
    placed = coded.select("*", F.posexplode("keys").alias("t", "key"))
    # Buckets of more than a tile are rare; their list is at most tables * vectors / tile long.
    large = kept(placed.groupBy("d", "t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).withColumn("parts", F.ceil(F.col("n") / tile).cast("int")), "large")
    if large.isEmpty():
        placed = placed.withColumn("parts", F.lit(1))
    else:
        placed = placed.join(large.drop("n"), ["d", "t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("rid", F.lit(seed)), F.col("parts")).cast("int")
    placed = placed.withColumn("part", part)
    # A part meets every part of its bucket once: as the first of a pair of parts, or as the second.
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("part"), o).alias("a"), F.greatest(F.col("part"), o).alias("b")))
    spread = placed.select("rid", "copies", "unit", "keys", "code", "factor", "d", "t", "key", "part", F.explode(met).alias("m")).select("*", "m.a", "m.b").drop("m")

    def links(batches):
        work = None
        out: dict[str, list] = {"u": [], "v": [], "more": []}

        def finish(pdf: pd.DataFrame) -> None:
            nonlocal work
            if len(pdf) < 2:
                return
            dim = int(pdf["d"].iloc[0])
            if work is None or work.dim != dim:  # buckets come by length
                work = Tile(dim, threshold, eps, seed)
            table, a, b = int(pdf["t"].iloc[0]), int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
            rid, copies, part = pdf["rid"].to_numpy(), pdf["copies"].to_numpy(), pdf["part"].to_numpy()
            all_ = work.prepared(np.stack(pdf["unit"].to_numpy()), np.stack(pdf["keys"].to_numpy()), pdf["code"].tolist(), pdf["factor"].to_numpy())
            pick = lambda at: {k: v[at] for k, v in all_.items()}
            if a == b:
                i, j = work.compare(all_, all_, table, True)
            else:
                left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
                i, j = work.compare(pick(left), pick(right), table, False)
                i, j = left[i], right[j]
            if len(i):
                more = np.bincount(i, copies[j], len(rid)) + np.bincount(j, copies[i], len(rid))
                at = np.flatnonzero(more)
                out["u"] += rid[at].tolist()
                out["v"] += [None] * len(at)
                out["more"] += more[at].astype(np.int64).tolist()
                for x, y in forest(len(rid), i, j):
                    out["u"].append(int(rid[x]))
                    out["v"].append(int(rid[y]))
                    out["more"].append(None)

        def told() -> pd.DataFrame:
            pdf = pd.DataFrame({k: pd.array(v, "Int64") for k, v in out.items()})
            for v in out.values():
                v.clear()
            return pdf

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            code = pdf[["d", "t", "key", "a", "b"]].to_numpy()
            cuts = np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist()]
            for x, y in zip(bounds, bounds[1:], strict=False):
                if y - x > 1:
                    finish(pdf.iloc[x:y])
            rest = pdf.iloc[bounds[-1] :]
            if len(out["u"]) > 50_000:
                yield told()
        if rest is not None:
            finish(rest)
        yield told()

    keys = ["d", "t", "key", "a", "b"]
    dealt = spread.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(lean(links), "u long, v long, more long")
