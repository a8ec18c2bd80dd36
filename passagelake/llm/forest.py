"""Problem 2: the most similar vectors of every vector, by a hash-prefix forest.

Each tree writes every vector's direction as a long hash string: the nearest of the tree's own centres, then the sides of
random hyperplanes on which the rest of the vector lies, then random bits. Sorted by it, vectors with a common prefix
stand together. A vector descends in every tree to the longest prefix it shares with any other, and then ascends in all
trees at once, a bit at a time, until those who share the prefix of that length with it are, over all trees together,
enough: where one tree has few near it, the others are not asked for more of the far ones. How many share a prefix is
estimated from the sample that the trees are fitted on, so that the length is known when a vector is hashed; who they are
is seen in the whole sorted array. Vectors of one prefix and length are compared by one matrix product.

The sorted array of a tree is range-partitioned; a prefix with more than 2 * `bucket` members is divided further by the
vectors themselves, so neither copies nor a dense cluster can fill a task, and one with fewer than `least` takes in its
neighbours. As near vectors part more often the finer a table is cut, trees, bucket and centres grow with the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import UUID

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8192  # vectors the trees' centres and range boundaries are fitted on at most
BITS, SALT = 24, 24
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


def pack_id(s: str) -> bytes:
    """A shorter form of an id that can be undone exactly."""
    return b"\x01" + UUID(s).bytes if _UUID.fullmatch(s) else b"\x00" + s.encode()


def unpack_id(b: Column) -> Column:
    h = F.lower(F.hex(F.substring(b, 2, 16)))
    cut = [F.substring(h, p, n) for p, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.hex(F.substring(b, 1, 1)) == "01", F.concat_ws("-", *cut)).otherwise(F.decode(F.substring(b, 2, 1 << 30), "UTF-8"))


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (as positions) and unit vectors of the usable vectors of a list column."""
    col = col.cast(pa.list_(pa.float32())) if not pa.types.is_list(col.type) or col.type.value_type != pa.float32() else col
    fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False))
    if not len(fit):
        return fit, np.zeros((0, dim), np.float32)
    flat = pc.list_flatten(col.take(pa.array(fit)))
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    big = np.abs(x).max(1)
    ok = np.isfinite(big) & (big > 0)
    x = x[ok] / big[ok][:, None]
    return fit[ok], x / np.linalg.norm(x, axis=1)[:, None]


def grown(rows: int, trees: int, bucket: int, centres: int) -> tuple[int, int, int]:
    """Trees, bucket and centres for a table of so many rows: beyond 30 buckets the cells and the centres grow with the root of the rows, beyond 75 each doubling adds a tree."""
    f = max(1.0, rows / (30 * bucket)) ** 0.5
    return trees + int(np.log2(max(1.0, rows / (75 * bucket)))), int(bucket * f), int(centres * f)


class Forest:
    """Centres, hyperplanes and range boundaries of all trees; its size depends on the sample, not on the data."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, centres: int, partition_rows: int, seed: int = 11):
        r = np.random.default_rng(seed)
        self.trees, dim = trees, sample.shape[1]
        self.scale = rows / max(len(sample), 1)
        self.sorted: list[np.ndarray] = []
        self.parts = max(1, -(-rows // partition_rows))
        self.centres, self.planes, self.bounds = [], [], []
        for _ in range(trees):
            self.centres.append(self._kmeans(sample, max(1, min(centres, len(sample) // 8)), r))
            self.planes.append(r.standard_normal((dim, BITS)).astype(np.float32))
        for t in range(trees):
            keys = np.sort(self.keys(sample, t, r.integers(0, 1 << SALT, len(sample))))
            self.sorted.append(keys)
            at = (np.arange(1, self.parts) * len(keys)) // self.parts
            self.bounds.append(keys[at] if len(keys) else np.zeros(0, np.int64))

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = 6) -> np.ndarray:
        if not len(x):
            return np.zeros((1, x.shape[1]), np.float32)
        c = x[r.choice(len(x), k, replace=False)].copy()
        for _ in range(rounds):
            a = (x @ c.T).argmax(1)
            s = np.zeros_like(c)
            np.add.at(s, a, x)
            n = np.linalg.norm(s, axis=1)
            s[n == 0], n[n == 0] = x[r.integers(0, len(x), int((n == 0).sum()))], 1.0
            c = s / np.linalg.norm(s, axis=1)[:, None]
        return c

    def keys(self, x: np.ndarray, t: int, salt: np.ndarray) -> np.ndarray:
        """The hash strings of unit vectors in tree t, as integers: centre, hyperplane bits, salt."""
        if not len(x):
            return np.zeros(0, np.int64)
        dots = x @ self.centres[t].T
        c = dots.argmax(1)
        # the part of the vector beside its centre, seen from the hyperplanes
        side = x @ self.planes[t] - dots[np.arange(len(x)), c][:, None] * (self.centres[t] @ self.planes[t])[c]
        bits = ((side > 0) @ (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)).astype(np.int64)
        return (c.astype(np.int64) << (BITS + SALT)) | (bits << SALT) | salt.astype(np.int64)

    def depth(self, keys: list[np.ndarray], enough: float) -> np.ndarray:
        """How many bits after the centre each vector, given by its keys in all trees, shares with its candidates: the most at which these are, over all trees, `enough` by the sample."""
        n = len(keys[0])
        low, high = np.zeros(n, np.int64), np.full(n, BITS, np.int64)  # `low` bits give enough, or are the fewest there are
        while (low < high).any():
            mid = (low + high + 1) // 2
            shift = BITS + SALT - mid
            found = np.zeros(n)
            for t in range(self.trees):
                first = keys[t] >> shift << shift
                found += np.searchsorted(self.sorted[t], first + (np.int64(1) << shift)) - np.searchsorted(self.sorted[t], first)
            ok = found * self.scale >= enough
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low.astype(np.int8)

    def part(self, keys: np.ndarray, t: int) -> np.ndarray:
        return t * self.parts + np.searchsorted(self.bounds[t], keys, "right")


def prefix_groups(keys: np.ndarray, bucket: int, least: int) -> list[tuple[int, int]]:
    """Ranges of the sorted `keys`, each the longest common prefix with at most `bucket` members; a prefix is not left for longer ones if one of these has fewer than `least`: at any size such a cell joins the neighbour with which it shares more bits."""
    out: list[tuple[int, int]] = []
    edges = np.r_[0, np.flatnonzero(np.diff(keys >> (BITS + SALT))) + 1, len(keys)]
    small = 0
    stack: list[tuple[int, int, int]] = []
    for k in range(len(edges) - 1):  # centres with too few members join their neighbours
        if edges[k + 1] - edges[small] >= least or k == len(edges) - 2:
            stack.append((int(edges[small]), int(edges[k + 1]), BITS + SALT - 1))
            small = k + 1
    while stack:
        a, b, bit = stack.pop()
        if b - a <= bucket or bit < 0:
            while b - a > bucket:  # equal to the last bit: blocks
                out.append((a, a + bucket))
                a += bucket
            out.append((a, b))
            continue
        one = keys[a:b] >> bit & 1
        m = a + int(np.searchsorted(one, 1)) if (np.diff(one) >= 0).all() else -1
        if m < 0:  # several centres in one range: split in the middle
            m = (a + b) // 2
            stack += [(a, m, bit), (m, b, bit)]
        elif m - a and b - m:
            stack += [(a, m, bit - 1), (m, b, bit - 1)]
        else:
            stack.append((a, b, bit - 1))
    whole: list[tuple[int, int]] = []
    for a, b in sorted(x for x in out if x[1] > x[0]):
        back = bool(whole) and (b == len(keys) or keys[a - 1] ^ keys[a] <= keys[b - 1] ^ keys[b])  # shares more bits with the cell before than with the next
        if whole and (whole[-1][1] - whole[-1][0] < least or b - a < least and back):
            whole[-1] = (whole[-1][0], b)
        else:
            whole.append((a, b))
    return whole


def further_bits(keys: np.ndarray, q: np.ndarray, bucket: int, seed: int) -> np.ndarray:
    """The sorted `keys` with the random bits of more than `bucket` equal hashes replaced by the sides of planes between two means of these vectors themselves, halving them until no more than `bucket` agree."""
    keys, r = keys.copy(), np.random.default_rng(seed)
    edges = np.r_[0, np.flatnonzero(np.diff(keys >> SALT)) + 1, len(keys)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a <= bucket:
            continue
        path = np.zeros(b - a, np.int64)
        stack = [(np.arange(b - a), SALT - 1)]
        while stack:
            at, bit = stack.pop()
            if len(at) <= bucket or bit < 0:
                continue
            some = q[a + r.choice(at, min(len(at), 512), replace=False)].astype(np.float32)
            one, two = some[0], some[((some - some[0]) ** 2).sum(1).argmax()]
            for _ in range(4):
                side = some @ (one - two) > (one @ one - two @ two) / 2
                if side.all() or not side.any():
                    break
                one, two = some[side].mean(0), some[~side].mean(0)
            order = at[np.argsort(q[a + at].astype(np.float32) @ (one - two), kind="stable")]
            low, high = np.sort(order[: len(at) // 2]), np.sort(order[len(at) // 2 :])
            path[high] |= 1 << bit
            stack += [(low, bit - 1), (high, bit - 1)]
        keys[a:b] = (keys[a:b] >> SALT << SALT) | path
    return keys


def candidate_ranges(keys: np.ndarray, depth: np.ndarray, bucket: int, least: int) -> list[tuple[np.ndarray, int, int]]:
    """Rows and the range of the sorted `keys` that they are compared with: all that share centre and `depth` bits with them.

    A range of more than 2 * bucket is replaced by the cells into which prefix_groups divides it; one of fewer than `least`
    is widened by its neighbours.
    """
    out: list[tuple[np.ndarray, int, int]] = []
    cells: dict[tuple[int, int], np.ndarray] = {}
    n = len(keys)
    for d in np.unique(depth):
        rows = np.flatnonzero(depth == d)
        pre = keys >> (BITS + SALT - int(d))
        lo, hi = np.searchsorted(pre, pre[rows], "left"), np.searchsorted(pre, pre[rows], "right")
        cut = np.r_[0, np.flatnonzero(np.diff(lo)) + 1, len(rows)]
        for i, j in zip(cut[:-1], cut[1:]):
            a, b, own = int(lo[i]), int(hi[i]), rows[i:j]
            if b - a > 2 * bucket:
                if (a, b) not in cells:
                    cells[a, b] = np.array([x for g in prefix_groups(keys[a:b], bucket, least) for x in g], np.int64).reshape(-1, 2) + a
                g = cells[a, b]
                at = np.searchsorted(g[:, 0], own, "right") - 1
                for c in np.unique(at):
                    out.append((own[at == c], int(g[c, 0]), int(g[c, 1])))
                continue
            if b - a < least:
                a, b = max(0, min(a, b - least)), min(n, max(b, a + least))
            out.append((own, a, b))
    return out


def nearest_in(q: np.ndarray, groups: list[tuple[np.ndarray, int, int]], k: int, width: int = 32_768) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per group: rows, their k nearest in its range and the cosines. q: small whole numbers, whose products are exact in float32. At most 1,024 rows meet `width` others at a time, whatever the range's size."""
    for rows, a, b in groups:
        if b - a < 2:
            continue
        m = min(k, b - a - 1)
        blocks = [(c, min(c + width, b)) for c in range(a, b, width)]
        held: tuple[int, np.ndarray, np.ndarray] | None = None
        for at in range(0, len(rows), 1024):
            own = rows[at : at + 1024]
            mine = q[own].astype(np.float32)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for c, e in blocks:
                if held is None or held[0] != c:
                    x = q[c:e].astype(np.float32)
                    held = (c, x, np.sqrt((x * x).sum(1, dtype=np.float64)))
                _, x, norm = held
                dots = mine @ x.T
                s = dots / norm.astype(np.float32)[None, :]
                inside = np.flatnonzero((own >= c) & (own < e))
                s[inside, own[inside] - c] = -np.inf
                top = np.argpartition(s, -m, axis=1)[:, -m:] if m < e - c else np.broadcast_to(np.arange(e - c), s.shape)
                found.append((top + c, np.take_along_axis(dots, top, 1).astype(np.float64) / norm[top]))
            near, cos = (np.concatenate(f, axis=1) for f in zip(*found, strict=True))
            cos = np.where(near == own[:, None], -np.inf, cos)
            if near.shape[1] > m:
                best = np.argpartition(cos, -m, axis=1)[:, -m:]
                near, cos = np.take_along_axis(near, best, 1), np.take_along_axis(cos, best, 1)
            yield own, near, cos / np.sqrt((mine * mine).sum(1, dtype=np.float64))[:, None]


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 768, trees: int = 4, bucket: int = 1024, least: int = 24, centres: int = 96, partition_rows: int = 16384, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """For every usable vector its k most similar others as far as the forest finds them: `key`, rank (from 1), other, cosine.

    key: a string column without nulls among usable rows; repeated keys count as one. Vectors that are null, of another
    length, all zero or not finite take no part. An empty table gives an empty one; a vector with fewer than k others
    gets those there are. Other columns are ignored. Cosines are those of the vectors rounded to 8 bits a number.
    Every row is indexed; only centres and boundaries are fitted on at most `sample` rows. One shuffle carries each vector
    once a tree in `dim` bytes, a second its k best a tree. trees, bucket and centres are those of small tables; `grown`
    has the rule by which they grow.
    """
    rows = df.count()
    trees, bucket, centres = grown(rows, trees, bucket, centres)
    partition_rows = max(partition_rows, 4 * bucket) if rows > partition_rows else partition_rows
    use = df.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = min(1.0, 1.3 * sample / max(rows, 1))
    got = use.where(h < int(share * (1 << 30)) + 1).select(vector).limit(2 * sample).toArrow()
    _, x = _matrix(got[vector].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float32())), dim)
    forest = Forest(x[:sample], rows, trees, centres, partition_rows, seed)
    del got, x

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                pos, x = _matrix(b.column(1), dim)
                if not len(pos):
                    continue
                ids = [pack_id(s) for s in b.column(0).take(pa.array(pos)).to_pylist()]
                q = np.rint(x * (127 / np.abs(x).max(1))[:, None]).astype(np.int8)
                off = np.arange(len(pos) + 1, dtype=np.int32) * dim
                q_col = pa.Array.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(q.tobytes())])
                keys = [forest.keys(x, t, np.array([hash_bytes(i, t) for i in ids], np.int64)) for t in range(forest.trees)]
                depth = pa.array(forest.depth(keys, forest.trees * bucket / 2))
                for t in range(forest.trees):
                    yield pa.RecordBatch.from_arrays([pa.array(forest.part(keys[t], t).astype(np.int32)), pa.array(keys[t]), depth, pa.array(ids, pa.binary()), q_col], names=["part", "h", "depth", "id", "q"])

    def searched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        del batches
        parts = t["part"].to_numpy()
        for p in np.unique(parts):
            own = np.flatnonzero(parts == p)
            keys = t["h"].to_numpy()[own]
            order = own[np.argsort(keys, kind="stable")]
            keys = np.sort(keys)
            depth = t["depth"].to_numpy()[order]
            ids = t["id"].combine_chunks().take(pa.array(order))
            flat = t["q"].combine_chunks()
            o = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
            q = np.frombuffer(flat.buffers()[2], np.int8)[o[0] : o[-1]].reshape(-1, dim)[order]
            keys = further_bits(keys, q, bucket, seed + int(p))
            if (np.diff(keys) < 0).any():
                again = np.argsort(keys, kind="stable")
                keys, q, depth, ids = keys[again], q[again], depth[again], ids.take(pa.array(again))
            for row, top, cos in nearest_in(q, candidate_ranges(keys, depth, bucket, least), k):
                n, m = top.shape
                off = pa.array(np.arange(n + 1, dtype=np.int32) * m)
                near = pa.StructArray.from_arrays([pa.array(cos.ravel()), ids.take(pa.array(top.ravel()))], ["cosine", "other"])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.ListArray.from_arrays(off, near)], names=["id", "near"])

    placed = use.mapInArrow(hashed, "part int, h long, depth byte, id binary, q binary").repartitionById(forest.trees * forest.parts, "part")
    found = placed.mapInArrow(searched, "id binary, near array<struct<cosine double, other binary>>")
    all_ = found.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))  # at most trees * k entries
    best = F.slice(F.reverse(F.array_sort(F.array_distinct("near"))), 1, k + 1)
    best = F.slice(F.filter(best, lambda x: x["other"] != F.col("id")), 1, k)
    ranked = all_.select(F.col("id").alias("_id"), best.alias("_near")).select("_id", F.posexplode("_near").alias("_rank", "_x"))
    return ranked.select(unpack_id(F.col("_id")).alias(key), (F.col("_rank") + 1).alias("rank"), unpack_id(F.col("_x.other")).alias("other"), F.col("_x.cosine").alias("cosine"))


def hash_bytes(b: bytes, seed: int = 0) -> int:
    """A stable hash of SALT bits."""
    import xxhash

    return xxhash.xxh64_intdigest(b, seed) & ((1 << SALT) - 1)


def pairs(found: DataFrame, key: str) -> DataFrame:
    """id_a < id_b of every pair of which at least one is among the other's nearest; distinct."""
    return found.select(F.least(key, "other").alias("id_a"), F.greatest(key, "other").alias("id_b")).where("id_a < id_b").distinct()
