"""Operator 3, n-gram Jaccard join with vertical partitioning.

A document's set holds its distinct shingles of `width` words. Two documents link when 100 * |intersection| >=
percent * |union|.

Global order: shingles are ordered by how often they occur, rarest first, then by hash. Counts come from all documents, in
a sketch whose counters grow with the characters of the input up to 2 ** MAX_SKETCH_BITS (16 MB as sent to the workers); a
collision there moves a shingle in the order, which costs time but never a link, as any global order is right. A shingle's
id carries its place in the order: 8 bits of frequency level above 56 bits of hash.

Candidates: linked sets share a shingle among their first n - ceil(percent n / 100) + 1, and sizes and positions bound
their overlap. Equal sets are one set.

1. The sets of each shared shingle are compared with one hub, the first in one fixed order of all sets, so that the
   shingles of a group agree on the hub. Shingles with many sets are dealt out into sublists with hubs of their own, which
   are then compared with the hub of the sublists. A group of k sets gives about k pairs, not k * k.
2. Shingles whose sets are in more than one component stay open. Their sets are compared in tiles: first by sizes and
   positions, after which sets without a partner leave, then, for one of the shingles with the same sets, by bitmaps that
   bound the overlap from above. Of the pairs between components that the bound leaves, the most alike that span a tile's
   components are verified, then, once components have grown, all that are left. Pairs leave a tile only as far as they
   can still join components.

Vertical partitioning: the global order is cut into FRAGMENTS ranges of equal mass; each set in a pair is cut into the same
fragments; each pair's overlap is counted in each fragment on its own and summed per pair. Only these sums make links.

Results: null texts and texts without a word have an empty set (n_shingles 0), link with nothing and are their own
component. With fewer words than `width` the whole sequence is one shingle. Repeated rows have equal sets. A row with null
id takes part; it never names a component that holds another id. Shingles are known by 64-bit hashes, 56 bits of it in
pairs: among a billion shingles of one corpus a given pair's overlap is off by one with odds below one in a million.
"""

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import doc_texts, free_name, lean, per_text
from veilspark.llm.components import components
from veilspark.llm.scratch import batches_of, dropped, kept

MIN_SKETCH_BITS, MAX_SKETCH_BITS, FRAGMENTS, CHUNKS = 16, 24, 4, 16
#: Frequency level (four times a binary logarithm) above which a shingle's sets are dealt into sublists; sets of one tile.
HOT_LEVEL, TILE = 40, 2048
#: Rows that may be broadcast, of four longs and of two. Beyond these counts both sides are shuffled.
BROADCAST_NODES, BROADCAST_IDS = 100_000, 1_000_000
#: Words whose hashes a worker remembers; bits of bitmaps that are multiplied at once.
MEMO, COLUMNS = 200_000, 8192
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def stirred(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed, one to one."""
    for m, s in ((MIX[1], 30), (MIX[2], 27)):
        x = (x ^ (x >> np.uint64(s))) * m
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts as sorted arrays of distinct 64-bit hashes."""

    def __init__(self, width: int):
        self.width, self.hashes = width, Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct hashes, sorted."""
        return np.unique(self.all(text))

    def all(self, text: str | None) -> np.ndarray:
        """The hash of each shingle, in the order of the text."""
        # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only, as asked for.
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = (out * MIX[0]) + h[i : i + n]
        return stirred(out)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two longs."""
    raw = blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Ids of the shingles in the global order."""
    bits = len(levels).bit_length() - 1
    level = levels[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (s & np.uint64((1 << 56) - 1))).astype(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each value of the highest bits of a hash, eight to sixteen bits for each shingle."""
    k = max(6, (8 * len(s) - 1).bit_length())
    seen = np.zeros(1 << k, bool)
    seen[(s >> np.uint64(64 - k)).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little").tobytes()


def packed(counts: np.ndarray) -> bytes:
    """Counts of 8 bytes by planes of bytes, of which the higher are mostly zero."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def sketch(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequency level of each counter: four times the binary logarithm of its number of shingles, at most 127; and the number
    of shingles of each level. The counters themselves stay with the workers.

    A counter for every 24 characters, about four shingles, within the bounds on their number.
    """
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bits = min(MAX_SKETCH_BITS, max(MIN_SKETCH_BITS, (chars // 24).bit_length()))
    step = (1 << bits) // CHUNKS
    schema = "chunk int, counts binary"

    def count(batches):
        sh, total = Shingler(width), np.zeros(1 << bits, np.int32)
        held, size = [], 0

        def add():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            total[at] += n.astype(np.int32)
            held.clear()

        for pdf in batches:
            for text in pdf["text"]:
                if len(s := sh.all(text)):
                    held.append((s >> np.uint64(64 - bits)).astype(np.int32))
                    if (size := size + len(s)) >= 1_000_000:
                        add()
                        size = 0
        if held:
            add()
        if total.any():
            yield pd.DataFrame({"chunk": range(CHUNKS), "counts": [packed(total[i * step : (i + 1) * step]) for i in range(CHUNKS)]})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for c, raw in zip(pdf["chunk"], pdf["counts"], strict=True):
                sums.setdefault(int(c), np.zeros(step, np.int64)).__iadd__(unpacked(raw))
        yield pd.DataFrame({"chunk": list(sums), "counts": [packed(x) for x in sums.values()]})

    def rated(batches):
        for pdf in merge(batches):
            for c, raw in zip(pdf["chunk"], pdf["counts"], strict=True):
                n = unpacked(raw)
                level = np.minimum(127, np.floor(4 * np.log2(np.maximum(1, n)))).astype(np.uint8)
                mass = np.bincount(level, n, 128).astype(np.int64)
                yield pd.DataFrame({"chunk": [c], "levels": [zlib.compress(level.tobytes(), 1)], "mass": [mass.tobytes()]})

    parts = docs.select("text").mapInPandas(lean(count), schema).withColumn("part", F.spark_partition_id() % 8)
    once = parts.repartition(CHUNKS * 8, "chunk", "part").select("chunk", "counts").mapInPandas(lean(merge), schema)
    rows = once.repartition(CHUNKS, "chunk").mapInPandas(lean(rated), "chunk int, levels binary, mass binary")
    levels, mass = np.zeros(1 << bits, np.uint8), np.zeros(128, np.int64)
    with batches_of(docs.sparkSession, 2000):
        found = rows.collect()  # CHUNKS rows, 2 ** bits levels of a byte in all
    for r in found:
        levels[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
        mass += np.frombuffer(r["mass"], np.int64)
    return levels, mass


def cuts(mass: np.ndarray, fragments: int) -> np.ndarray:
    """Ids at which fragments after the first begin, so that each holds about as many shingles. mass: shingles of each level."""
    upto = np.concatenate([[0], np.cumsum(mass)])
    out = []
    for q in range(1, fragments):
        want = upto[-1] * q / fragments
        k = int(np.searchsorted(upto, want, "right")) - 1
        k = min(max(k, 0), 127)
        part = (want - upto[k]) / mass[k] if mass[k] else 0.0
        out.append((k << 56) + int(part * ((1 << 56) - 1)))
    return np.array(out, np.int64)


def linked(n, m, overlap, percent: int):
    """Whether an overlap of sets of sizes n and m makes a link. Columns or arrays."""
    return (100 + percent) * overlap >= percent * (n + m)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted keys begin and end."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return begin, np.append(begin[1:], len(keys)) if len(keys) else begin


def sublists(token: np.ndarray, rid: np.ndarray, hot: int) -> np.ndarray:
    """The sublist of each occurrence: one and the same for a shingle up to the level `hot`, beyond it one of a number that
    doubles with the frequency."""
    level = token >> np.int64(56)
    many = np.left_shift(np.uint64(1), np.clip(-(-(level - hot) // 4), 0, 62).astype(np.uint64))
    return stirred(rid.astype(np.uint64) * MIX[0]) & (many - np.uint64(1))


TOKENS = "kind int, token long, rid long, n long, pos long, h long, hn long"
PAIR, SHARED, HUB = range(3)


def dealt(parts: int, hot: int):
    """A function from batches of sets (rid, n, prefix) to their shingles, packed by the part that handles them."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = np.fromiter(map(len, pdf["prefix"]), np.int64, len(pdf))
            if not sizes.sum():
                continue
            token = np.concatenate(pdf["prefix"].to_numpy()).astype(np.int64)
            rid = np.repeat(pdf["rid"].to_numpy(np.int64), sizes)
            n = np.repeat(pdf["n"].to_numpy(np.int64), sizes)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            part = (stirred(token.astype(np.uint64) + sublists(token, rid, hot) * MIX[0]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, token, rid, at = part[order], token[order], rid[order], ((n << 32) + pos)[order]
            begin, end = runs(part)
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(begin, end, strict=True)]  # noqa: B023, E731
            yield pd.DataFrame({"part": part[begin], "token": cut(token), "rid": cut(rid), "at": cut(at)})

    return deal


def with_hubs(percent: int, hot: int):
    """A function from packed shingles to pairs with hubs, occurrences of shared shingles, and hubs of sublists."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: list[list[bytes]] = [[], [], []]
        for pdf in batches:
            for held, c in zip(raw, ("token", "rid", "at"), strict=True):
                held.extend(pdf[c])
        token, rid, at = (np.frombuffer(b"".join(held), np.int64) for held in raw)
        raw.clear()
        if not len(token):
            return
        rank = stirred(rid.astype(np.uint64) * MIX[2])  # one order for all shingles
        sub = sublists(token, rid, hot)
        order = np.lexsort((rank, sub, token))
        token, rid, at, rank, sub = (x[order] for x in (token, rid, at, rank, sub))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (sub[1:] != sub[:-1])])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]  # of each occurrence the hub's
        size = np.diff(np.append(np.flatnonzero(new), len(token)))[np.cumsum(new) - 1]
        split = (token >> np.int64(56)) > hot
        n, pos = at >> np.int64(32), at & np.int64((1 << 32) - 1)

        def rows(kind: int, which: np.ndarray, h: np.ndarray, hn: np.ndarray) -> Iterator[pd.DataFrame]:
            for s in range(0, len(which), 200_000):
                i = which[s : s + 200_000]
                yield pd.DataFrame({"kind": np.int32(kind), "token": token[i], "rid": rid[i], "n": n[i], "pos": pos[i], "h": h[i], "hn": hn[i]})

        room = np.minimum(n - pos, n[first] - pos[first])
        fits = linked(n, n[first], room, percent) & (first != np.arange(len(token)))
        pair = np.flatnonzero(fits)
        pair = pair[np.unique(np.stack([rid[pair], rid[first[pair]]]), axis=1, return_index=True)[1]] if len(pair) else pair
        yield from rows(PAIR, pair, rid[first], n[first])
        yield from rows(SHARED, np.flatnonzero((size > 1) | split), rid, n)
        yield from rows(HUB, np.flatnonzero(new & split), rank.astype(np.int64), n)

    return work


def unfolded(raw: list[bytes], a: int, b: int) -> np.ndarray:
    """Bits a to b of bitmaps of one length."""
    return np.unpackbits(np.stack([np.frombuffer(x, np.uint8)[a >> 3 : b >> 3] for x in raw]), axis=1, bitorder="little")


def bounds(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most that each of the first sets can share with each of the second; all bitmaps of a side are of one length.

    A longer bitmap is folded to the shorter one's length. Bits that one set has and the other lacks stand for as many
    shingles at least that the two do not share.
    """
    if len(x[0]) > len(y[0]):
        return bounds(y, x, m, n).T
    bits, fold = 8 * len(x[0]), len(y[0]) // len(x[0])
    both, p, q = np.zeros((len(x), len(y)), np.float32), np.zeros(len(x), np.float32), np.zeros(len(y), np.float32)
    step = max(64, COLUMNS // fold)
    for a in range(0, bits, step):
        b = min(bits, a + step)
        u = unfolded(x, a, b).astype(np.float32)
        v = unfolded(y, a * fold, b * fold).reshape(len(y), b - a, fold).any(2).astype(np.float32)
        both += u @ v.T
        p += u.sum(1)
        q += v.sum(1)
    return np.minimum(n[:, None] - (p[:, None] - both), m[None, :] - (q[None, :] - both))


def spanning(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links (i, j), best first, span what all of them join of the components."""
    root = np.unique(comp, return_inverse=True)[1]
    out, at = [], np.arange(len(i))
    while True:
        x, y = root[i[at]], root[j[at]]
        at = at[x != y]
        if not len(at):
            return np.concatenate(out) if out else at
        x, y = root[i[at]], root[j[at]]
        best = np.full(root.max() + 1, len(at))
        np.minimum.at(best, x, np.arange(len(at)))
        np.minimum.at(best, y, np.arange(len(at)))
        pick = np.unique(best[best < len(at)])
        out.append(at[pick])
        name = np.arange(root.max() + 1)
        while (name[x[pick]] != name[y[pick]]).any():
            low = np.minimum(name[x[pick]], name[y[pick]])
            np.minimum.at(name, name[x[pick]], low)
            np.minimum.at(name, name[y[pick]], low)
            while (name[name] != name).any():
                name = name[name]
        root = name[root]


def tile_pairs(percent: int, every: bool):
    """A function from rows (token, a, b, part, rid, n, c, bits), tile after tile, to pairs (rid, n, h, hn) that may link
    components: those that span, or every one."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame | None:
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        rid, n, c, part = (pdf[k].to_numpy(np.int64) for k in ("rid", "n", "c", "part"))
        if (c == c[0]).all():
            return None
        raw = pdf["bits"].tolist()
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        found = []
        for s in np.unique(size):
            for t in np.unique(size):
                x, y = np.flatnonzero((size == s) & (part == a)), np.flatnonzero((size == t) & (part == b))
                if not len(x) or not len(y) or (a == b and s > t):
                    continue
                if 100 * min(n[x].max(), n[y].max()) < percent * max(n[x].min(), n[y].min()):
                    continue
                for k in range(0, len(x), 512):
                    z = x[k : k + 512]
                    top = bounds([raw[w] for w in z], [raw[w] for w in y], n[z], n[y])
                    ok = linked(n[z][:, None], n[y][None, :], top, percent) & (c[z][:, None] != c[y][None, :])
                    if a == b and s == t:
                        ok &= z[:, None] < y[None, :]
                    i, j = np.nonzero(ok)
                    found.append((z[i], y[j], top[i, j] / (n[z][i] + n[y][j])))
        if not found:
            return None
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if not every:
            order = np.lexsort((np.maximum(rid[i], rid[j]), np.minimum(rid[i], rid[j]), -score))
            i, j = i[order], j[order]
            pick = spanning(c, i, j)
            i, j = i[pick], j[pick]
        return pd.DataFrame({"rid": rid[i], "n": n[i], "h": rid[j], "hn": n[j]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, edges in whole_tiles(batches):
            for x, y in zip(edges, edges[1:], strict=False):
                if (out := compare(pdf.iloc[x:y])) is not None:
                    yield out

    return work


def whole_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Rows of tiles that are complete, with the places where a tile begins and the last one ends."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        code = pdf[["token", "a", "b"]].to_numpy()
        edges = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1).tolist()]
        if len(edges) > 1:
            yield pdf.iloc[: edges[-1]], edges
        rest = pdf.iloc[edges[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, [0, len(rest)]


def with_partners(percent: int):
    """A function from rows (token, a, b, part, rid, n, pos, c), tile after tile, to those (token, rid, n, c) that have a partner
    in another component to which sizes and positions leave room for a link."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, edges in whole_tiles(batches):
            a, b, part, n, pos, c = (pdf[k].to_numpy(np.int64) for k in ("a", "b", "part", "n", "pos", "c"))
            end = np.repeat(edges[1:], np.diff(edges))
            found, k = np.zeros(len(pdf), bool), 1
            i = np.flatnonzero(np.arange(len(pdf)) + 1 < end)
            while len(i):  # all pairs of rows k apart, in all tiles at once
                j = i + k
                room = np.minimum(n[i] - pos[i], n[j] - pos[j])
                ok = (c[i] != c[j]) & linked(n[i], n[j], room, percent) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((a[i] == b[i]) | (part[i] != part[j]))
                found[i[ok]] = found[j[ok]] = True
                k += 1
                i = i[i + k < end[i]]
            yield pdf.loc[found, ["token", "rid", "n", "c"]]

    return work


class Join:
    """One join: the global order, the distinct sets, and the counting of overlaps."""

    def __init__(self, docs: DataFrame, width: int, percent: int, hot: int = HOT_LEVEL, tile: int = TILE):
        self.docs, self.width, self.percent, self.hot, self.tile = doc_texts(docs), width, percent, hot, tile
        levels, mass = sketch(self.docs, width)
        self.cuts = cuts(mass, FRAGMENTS)
        self.ready: DataFrame | None = None
        self.parts: DataFrame | None = None
        self.maps: DataFrame | None = None
        self.levels = docs.sparkSession.sparkContext.broadcast(levels)
        held, percent_ = self.levels, percent
        fields = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")] + [T.StructField("prefix", T.ArrayType(T.LongType()))])

        def make():
            sh = Shingler(width)

            def work(texts):
                out = []
                for t in texts:
                    s = sh(t)
                    n = len(s)
                    p = n - -(-percent_ * n // 100) + 1 if n else 0
                    out.append((n, *digest(s), ordered(s, held.value)[:p]))
                return out

            return work

        found = self.docs.select("doc_id", F.xxhash64("text").alias("hash"), per_text(make, fields, 2_000_000)("text").alias("c")).select("doc_id", "hash", "c.*")
        wide = kept(found, "shingles", 2000)
        sets = wide.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "prefix")))
        self.sets = kept(sets.withColumn("rid", F.monotonically_increasing_id()), "sets")
        self.rows = kept(wide.select("doc_id", "hash", "n", "d1", "d2"), "rows")
        dropped(wide)

    def shared(self) -> DataFrame:
        """Rows of TOKENS: pairs with hubs, and the occurrences of prefix shingles that more than one set has."""
        spark = self.sets.sparkSession
        parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        blobs = self.sets.select("rid", "n", "prefix").mapInPandas(lean(dealt(parts, self.hot)), "part int, token binary, rid binary, at binary")
        return blobs.repartition("part").select("token", "rid", "at").mapInPandas(lean(with_hubs(self.percent, self.hot)), TOKENS)

    def hub_pairs(self, tokens: DataFrame) -> DataFrame:
        """Rows (rid, n, h, hn): sets with the hub of a shingle they share, if sizes and positions leave room for a link."""
        own = tokens.filter(F.col("kind") == PAIR).select("rid", "n", "h", "hn")
        hubs = tokens.filter(F.col("kind") == HUB).select("token", "rid", "n", "pos", F.col("h").alias("rank"))
        top = hubs.groupBy("token").agg(F.min(F.struct("rank", "rid", "n", "pos")).alias("t"))
        met = hubs.join(top, "token").filter(F.col("rid") != F.col("t.rid"))
        room = F.least(F.col("n") - F.col("pos"), F.col("t.n") - F.col("t.pos"))
        met = met.filter(linked(F.col("n"), F.col("t.n"), room, self.percent))
        return own.unionByName(met.select("rid", "n", F.col("t.rid").alias("h"), F.col("t.n").alias("hn")))

    def pairs(self, rows: DataFrame) -> DataFrame:
        """Distinct (a, b, na, nb) with a < b from rows(rid, n, h, hn)."""
        low = F.col("rid") < F.col("h")
        both = ((F.least("rid", "h"), "a"), (F.greatest("rid", "h"), "b"), (F.when(low, F.col("n")).otherwise(F.col("hn")), "na"), (F.when(low, F.col("hn")).otherwise(F.col("n")), "nb"))
        return rows.select(*(c.alias(x) for c, x in both)).distinct()

    def fragments(self, nodes: DataFrame) -> None:
        """Adds the fragments and bitmaps of those sets in nodes(rid) that have none yet: one text of each is read again and cut."""
        new = nodes if self.ready is None else nodes.join(self.ready, "rid", "left_anti")
        new = kept(new.join(self.sets.select("rid", "least", "d1", "d2"), "rid"), "nodes")
        count = new.count()
        if not count:
            if self.parts is None:
                self.parts = nodes.sparkSession.createDataFrame([], "rid long, fragment int, ids array<long>")
                self.maps = nodes.sparkSession.createDataFrame([], "rid long, bits binary")
            return
        held, width, at = self.levels, self.width, self.cuts

        def make():
            sh = Shingler(width)

            def work(texts):
                out = []
                for t in texts:
                    s = sh(t)
                    ids = ordered(s, held.value)
                    out.append((*digest(s), bitmap(s), *np.split(ids, np.searchsorted(ids, at))))
                return out

            return work

        names = [f"f{i}" for i in range(FRAGMENTS)]
        fields = T.StructType([T.StructField(c, T.LongType()) for c in ("e1", "e2")] + [T.StructField("bits", T.BinaryType())] + [T.StructField(c, T.ArrayType(T.LongType())) for c in names])
        # Up to a checked number of rows of four longs the sets are sent to the texts; beyond it both are shuffled.
        side = F.broadcast(new) if count <= BROADCAST_NODES else new
        texts = self.docs.join(side, self.docs["doc_id"].eqNullSafe(new["least"])).select("rid", "d1", "d2", "text")
        # Written before rows of another set are left out: else that filter would take the function below the join, to all texts.
        cut = texts.select("rid", "d1", "d2", per_text(make, fields, 2_000_000)("text").alias("c"))
        same = (F.col("c.e1") == F.col("d1")) & (F.col("c.e2") == F.col("d2"))
        written = kept(cut.select("rid", same.alias("same"), "c.bits", *(f"c.{c}" for c in names)), "fragments", 1000).filter("same")
        parts = written.select("rid", F.posexplode(F.array(*names)).alias("fragment", "ids")).filter(F.size("ids") > 0)
        maps = written.groupBy("rid").agg(F.first("bits").alias("bits"))  # an id may stand in several rows
        self.parts = parts if self.parts is None else self.parts.unionByName(parts)
        self.maps = maps if self.maps is None else self.maps.unionByName(maps)
        self.ready = new.select("rid") if self.ready is None else self.ready.unionByName(new.select("rid"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b, na, nb), written, that link, by overlaps counted in fragments and summed."""
        self.fragments(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
        parts = self.parts
        a = parts.select(F.col("rid").alias("a"), "fragment", F.col("ids").alias("x"))
        b = parts.select(F.col("rid").alias("b"), "fragment", F.col("ids").alias("y"))
        some = pairs
        if pairs.count() <= BROADCAST_NODES:  # few pairs go to the fragments, and only the fragments that they name move
            some = F.broadcast(pairs)
            b = b.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        counted = a.join(some, "a").join(b, ["b", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("x", "y")).alias("o"))
        counted = counted.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("o").alias("o"))  # an id may stand in several rows
        total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o")).filter(linked(F.col("na"), F.col("nb"), F.col("o"), self.percent))
        return kept(total.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    def components(self) -> DataFrame:
        """(node, component) for sets with a link."""
        tokens = kept(self.shared(), "tokens")
        tried = kept(self.pairs(self.hub_pairs(tokens)), "pairs")
        groups = kept(components(self.links(tried)), "components")
        for every in (False, True):
            near = self.pairs(self.tiles(tokens, groups, every))
            near = kept(near.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs", 2000)
            if near.isEmpty():
                continue  # what spans is known; there may be more
            tried = tried.unionByName(near)
            stars = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
            groups = kept(components(stars.unionByName(self.links(near))), "components")
        dropped(tokens)
        return groups

    def tiles(self, tokens: DataFrame, groups: DataFrame, every: bool) -> DataFrame:
        """Rows (rid, n, h, hn) of sets in different components that share an open shingle and may link."""
        own = tokens.filter(F.col("kind") == SHARED).select("token", "rid", "n", "pos")
        own = own.join(groups, own["rid"] == groups["node"], "left").select("token", "rid", "n", "pos", F.coalesce("component", "rid").alias("c"))
        own = kept(own, "placed")
        lists = own.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many")).filter("lo < hi")
        rows = self.tiled(own.join(kept(lists.select("token", "many"), "lists"), "token"), ["rid", "n", "pos", "c"])
        own = kept(rows.mapInPandas(lean(with_partners(self.percent)), "token long, rid long, n long, c long").distinct(), "partners")
        # Of shingles that are left with the same sets one stays: they are known by two hashes over all their sets.
        lists = own.groupBy("token").agg(F.count("*").alias("many"), *(F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"x{k}") for k in (1, 2)))
        lists = lists.groupBy("many", "x1", "x2").agg(F.min("token").alias("token")).select("token", "many")
        rows = kept(own.join(lists, "token"), "open")
        self.fragments(rows.select("rid").distinct())
        return self.tiled(rows.join(self.maps, "rid"), ["rid", "n", "c", "bits"]).mapInPandas(lean(tile_pairs(self.percent, every)), "rid long, n long, h long, hn long")

    def tiled(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """rows(token, many, columns) dealt out by tiles (token, a, b): a part of a list meets every part of it once, as the first
        of a pair of parts or as the second."""
        parts = F.ceil(F.col("many") / self.tile).cast("int")
        rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rid", F.lit(3)), F.col("parts")).cast("int"))
        met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("part"), o).alias("a"), F.greatest(F.col("part"), o).alias("b")))
        keys = ["token", "a", "b"]
        rows = rows.select("token", "part", *columns, F.explode(met).alias("m")).select("token", "m.a", "m.b", "part", *columns)
        return rows.repartition(*keys).sortWithinPartitions(*keys)


def placed(join: Join) -> DataFrame:
    """Each row of the input with words: doc_id, hash of its text, n, and the number c of its component."""
    groups = kept(join.components(), "components")
    named = join.sets.select("rid", "d1", "d2").join(groups, join.sets["rid"] == groups["node"], "left")
    named = kept(named.select("d1", "d2", F.coalesce("component", "rid").alias("c")), "named")
    return kept(join.rows.filter("n > 0").join(named, ["d1", "d2"]).select("doc_id", "hash", "n", "c"), "placed")


def near_copies(docs: DataFrame, width: int = 4, percent: int = 85, **settings: int) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text)."""
    join = Join(docs, width, percent, **settings)
    full = placed(join)
    least = kept(full.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    full = full.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = join.rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(bare)


def representatives(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one document of each group, and all without a word.

    The smallest doc_id of a group stays, nulls last; of rows that repeat this id the one whose text has the smallest hash,
    and of rows that repeat its text too, one.
    """
    rows = placed(Join(docs, width, percent))
    first = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    told = kept(rows.join(first, "c").groupBy("doc_id", "hash").agg(F.max(stays).alias("stays"), F.count("*").alias("many")), "told")
    names = {c: free_name(docs, c) for c in ("near_id", "near_hash")}
    key, code = names.values()
    out = docs.withColumns({key: docs["doc_id"].cast("long"), code: F.xxhash64(docs["text"].cast("string"))})

    def side(which: DataFrame) -> tuple[DataFrame, Column]:
        some = kept(which.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")), "told")
        # Up to a checked number of rows of two longs the ids are sent to the texts; beyond it both are shuffled.
        return F.broadcast(some) if some.count() <= BROADCAST_IDS else some, out[key].eqNullSafe(some["_id"]) & (out[code] == some["_hash"])

    twice = told.filter("stays and many > 1")
    hot = None
    if not twice.isEmpty():
        hot = out.join(*side(twice), "left_semi").dropDuplicates([key, code])
    out = out.join(*side(told.filter("not stays or many > 1")), "left_anti")
    return (out if hot is None else out.unionByName(hot)).drop(key, code)
