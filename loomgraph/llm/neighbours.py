"""The most similar vectors for every vector, by cross-polytope hashing with exact reranking.

Unit vectors go through pseudo-rotations (three rounds of random signs and fast Hadamard transform) and are assigned to the
nearest signed axis: one digit. Each table uses digits of its own; a bucket is as many leading digits as it takes to hold at most
BUCKET vectors, which is found from counts, so the depth follows the data. A vector also probes, in each table, the bucket of its
second-nearest axis. Members of a bucket are scored against each other in one matrix product on 8-bit copies, and the best go on
to exact reranking. What is still larger after DIGITS digits is made of vectors so alike that they share every digit: there all
meet all, on the vectors themselves, as blocks of members that the whole bucket is streamed past. Such buckets with the same members
(those of other tables) are searched once. The time for them grows with the square of their size, the memory does not.

Hashing finds near vectors only. A vector with fewer than k others at a cosine of CLOSE is held against all vectors of its model, block
against block as above, unless the caller asks for no others than close ones; this is exact, and its time grows with the number
of such vectors times that of all.

Equal vectors are searched once and stand for all their ids; any number of copies costs one search. Only vectors of the same model and
length are compared. Vectors shorter than their stated dimensions, with nulls or NaN, or of zero length have no neighbours.
Repeated ids are one record. Ties in similarity go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cut

TABLES, PROBES, DIGITS, BUCKET = 10, 2, 4, 1024
#: Cosines from here on are left to hashing.
CLOSE = 0.8
#: What rounding to eight bits may take from a cosine.
SLACK = 0.03


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, table: int, digit: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second-nearest signed axis, 0 .. 2d - 1, of each row after the table's pseudo-rotation."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table, digit, d])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    size = np.abs(y)
    two = np.argpartition(-size, 1, axis=1)[:, :2]
    swap = size[np.arange(len(x)), two[:, 0]] < size[np.arange(len(x)), two[:, 1]]
    two[swap] = two[swap][:, ::-1]
    sign = y[np.arange(len(x))[:, None], two] < 0
    return two[:, 0] * 2 + sign[:, 0], two[:, 1] * 2 + sign[:, 1]


HASHED = "cid long, model string, tab int, d1 int, d2 int, d3 int, d4 int, q binary"


def _hashed(tables: int, probes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, g in pdf.groupby(pdf["vector"].map(len)):
                x = np.stack(g["vector"].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                top = np.abs(x).max(1, keepdims=True)
                # one scale for each vector: it does not change a cosine, and uses all of the eight bits
                q = np.rint(x / top * 127).astype(np.int8)
                raw = [r.tobytes() for r in q]
                for t in range(tables):
                    first, second = axes(x, t, 1)
                    rest = [axes(x, t, k)[0] for k in range(2, DIGITS + 1)]
                    for p, d1 in enumerate((first, second)[:probes]):
                        yield pd.DataFrame({"cid": g["cid"].to_numpy(), "model": g["model"].to_numpy(), "tab": t, "d1": d1, "d2": rest[0], "d3": rest[1], "d4": rest[2], "q": raw})

    return run


def _bucket_pairs(k: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, part, cid, q) with one bucket after the other -> candidate pairs a < b."""

    def pairs(cids: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cids, first = np.unique(cids, return_index=True)
        if len(cids) < 2 or len({len(raw[i]) for i in first}) > 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = np.frombuffer(b"".join(raw[i] for i in first), np.int8).reshape(len(cids), -1).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        left, right = [], []
        for at in range(0, len(x), BUCKET):
            s = x[at : at + BUCKET] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            n = min(2 * k, s.shape[1] - 1)
            best = np.argpartition(-s, n - 1, axis=1)[:, :n]
            i = np.repeat(np.arange(len(s)), n)
            j = best.ravel()
            ok = s[i, j] >= least - SLACK
            left.append(cids[i[ok] + at])
            right.append(cids[j[ok]])
        a, b = np.concatenate(left), np.concatenate(right)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cids, raw = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            a, b = pairs(np.concatenate(cids), raw)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cid, q = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]))) if len(key) else []
            for x, y in zip(edge[:-1], edge[1:]):
                me = (key[x], part[x])
                if me != now:
                    if cids:
                        yield from out()
                    now, cids, raw = me, [], []
                cids.append(cid[x:y])
                raw += q[x:y]
        if cids:
            yield from out()

    return run


def _block_pairs(k: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, part, side, cid, vector) sorted by these: the members of a part (side 0), then the whole bucket (side 1) -> the k
    most similar of each member."""

    def unit(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column(4)
        y = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
        return y / np.linalg.norm(y, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, ids, best, at = None, [], [], None, None

        def out() -> Iterator[pa.RecordBatch]:
            if best is None:
                return
            i, j = np.nonzero(best >= least)
            if len(i):
                a, b = ids[i], at[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(best[i, j])], names=["a", "b", "cosine"])

        for batch in batches:
            marks = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            edge = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]] + [len(marks)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                if marks[lo][:2] != now:
                    yield from out()
                    now, own, ids, best, at = marks[lo][:2], [], [], None, None
                part = batch.slice(lo, hi - lo)
                cid, x = part.column(3).to_numpy(), unit(part)
                if not marks[lo][2]:
                    own.append(x)
                    ids.append(cid)
                    continue
                if not len(ids):  # no member fell into this part
                    continue
                if best is None:
                    own, ids = np.concatenate(own), np.concatenate(ids)
                    best, at = np.full((len(ids), k), -2.0), np.zeros((len(ids), k), np.int64)
                for c in range(0, len(cid), BUCKET):
                    s = own @ x[c : c + BUCKET].T
                    s[ids[:, None] == cid[None, c : c + BUCKET]] = -2
                    s = np.concatenate((best, s), axis=1)
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    best = np.take_along_axis(s, top, 1)
                    at = np.where(top < k, np.take_along_axis(at, np.minimum(top, k - 1), 1), cid[np.clip(top - k + c, 0, len(cid) - 1)])
        yield from out()

    return run


def _cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            c = []
            for _, g in pdf.groupby(pdf["va"].map(len)):
                x, y = (np.stack(g[v].to_numpy()).astype(np.float64) for v in ("va", "vb"))
                c.append(pd.Series((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)), index=g.index))
            yield pdf[["a", "b"]].assign(cosine=pd.concat(c))


def _searched(classes: DataFrame, scored: DataFrame, k: int, least: float, bucket: int) -> DataFrame:
    """(a, b, cosine): the k + 1 most similar of every class that has fewer than k in scored, from all of its model and length."""
    served = scored.select(F.col("a").alias("cid")).unionAll(scored.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= k)
    rows = classes.select(F.xxhash64("model", F.size("vector")).alias("key"), "cid", "vector")
    lone = Cut(rows.join(served, "cid", "left_anti").select("key", "cid", "vector"), "lone").df
    parts = lone.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (4 * bucket)).cast("int").alias("parts"))
    own = lone.join(parts, "key").select("key", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "cid", "vector")
    whole = rows.join(parts, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "cid", "vector")
    # rounding may take a cosine below -1
    return own.unionByName(whole).repartition("key", "part").sortWithinPartitions("key", "part", "side").mapInArrow(_block_pairs(k + 1, least if least > -1 else -1.5), "a long, b long, cosine double")


def nearest(vectors: DataFrame, k: int = 10, least: float = -1.0, tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET, id: str = "id", vector: str = "vector", model: str = "model", dimensions: str = "dimensions") -> DataFrame:
    """(id, neighbour, cosine, rank 1..k): the k most similar vectors of the same model; with `least`, only those with such a cosine at least."""
    floor = max(least, CLOSE)
    v = F.col(vector)
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = vectors.filter(F.col(id).isNotNull() & v.isNotNull() & (F.size(v) == F.col(dimensions)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (square > 0))
    rows = sound.select(F.col(id).alias("id"), F.coalesce(F.col(model), F.lit("")).alias("model"), v.alias("vector"))
    # equal vectors of a model are one class; a 128-bit digest of the numbers tells them apart
    digest = F.concat_ws("|", F.xxhash64(F.lit(1), "model", "vector"), F.xxhash64(F.lit(2), "vector", "model"))
    rows = rows.withColumn("digest", digest).dropDuplicates(["id"])
    classes = rows.groupBy("digest").agg(F.min("model").alias("model"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"))
    classes = Cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes").df
    members = Cut(rows.select("id", "digest").join(classes.select("digest", "cid"), "digest").select("cid", "id"), "members").df

    hashed = Cut(classes.select("cid", "model", "vector").mapInPandas(_hashed(tables, probes), HASHED), "hashed").df
    prefix = lambda n: F.xxhash64("model", "tab", *[f"d{i}" for i in range(1, n + 1)])
    keyed = hashed.select("cid", "tab", "q", *[prefix(n).alias(f"p{n}") for n in range(1, DIGITS + 1)])
    counts = None
    for n in range(1, DIGITS):
        c = keyed.groupBy(F.col(f"p{n}").alias("p")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > bucket).select("p", F.lit(n).alias("level"))
        counts = c if counts is None else counts.unionByName(c)
    big = Cut(counts, "big").df
    depth = F.lit(DIGITS)
    for n in range(DIGITS - 1, 0, -1):
        deep = big.filter(F.col("level") == n).select(F.col("p").alias(f"b{n}"))
        keyed = keyed.join(deep, F.col(f"p{n}") == F.col(f"b{n}"), "left")
        depth = F.when(F.col(f"b{n}").isNull(), F.lit(n)).otherwise(depth)
    key = F.element_at(F.array(*[F.col(f"p{n}") for n in range(1, DIGITS + 1)]), depth)
    placed = keyed.select(key.alias("key"), "cid", "q", "tab", (depth == DIGITS).alias("deep"))
    last = placed.filter("deep").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("who")).filter(F.col("n") > bucket)
    # a key of the same members as another has the same pairs
    last = Cut(last.withColumn("one", F.min("key").over(Window.partitionBy("n", "who"))).select(F.col("key").alias("dk"), "n", (F.col("key") == F.col("one")).alias("searched")), "last").df
    placed = placed.select("key", "cid", "q", "deep").join(last, F.col("key") == F.col("dk"), "left")
    small = placed.filter("dk is null").select("key", F.lit(0).alias("part"), "cid", "q")
    candidates = small.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_pairs(k, floor), "a long, b long").distinct()
    # vectors of another length are another bucket
    parts = F.ceil(F.col("n") / (4 * bucket)).cast("int")
    deep = placed.filter("searched").select("key", "cid", parts.alias("parts")).join(classes.select("cid", "vector"), "cid")
    deep = deep.select(F.xxhash64("key", F.size("vector")).alias("key"), "cid", "vector", "parts")
    own = deep.select("key", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "cid", "vector")
    whole = deep.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "cid", "vector")
    blocks = own.unionByName(whole).repartition("key", "part").sortWithinPartitions("key", "part", "side").mapInArrow(_block_pairs(k + 1, floor), "a long, b long, cosine double")
    near = candidates.join(classes.select(F.col("cid").alias("a"), F.col("vector").alias("va")), "a").join(classes.select(F.col("cid").alias("b"), F.col("vector").alias("vb")), "b")
    exact = near.select("a", "b", "va", "vb").mapInPandas(_cosines, "a long, b long, cosine double").filter(F.col("cosine") >= floor)
    scored = Cut(exact.unionByName(blocks).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "scored").df
    if least < CLOSE:
        far = _searched(classes, scored, k, least, bucket)
        scored = Cut(scored.unionByName(far).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "scored").df

    # back to ids: at most k + 1 ids of a class can be anyone's neighbours
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).filter(F.col("r") <= k + 1).select(F.col("cid").alias("nc"), F.col("id").alias("neighbour"))
    own = classes.filter("n > 1").select(F.col("cid").alias("c"), F.col("cid").alias("nc"), F.lit(1.0).alias("cosine"))
    both = scored.select(F.col("a").alias("c"), F.col("b").alias("nc"), "cosine").unionByName(scored.select(F.col("b").alias("c"), F.col("a").alias("nc"), "cosine")).unionByName(own)
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cosine"), "nc"))).filter(F.col("r") <= k + 1)
    listed = top.join(few, "nc").select("c", "neighbour", "cosine")
    pairs = members.join(listed, members["cid"] == listed["c"]).filter("id <> neighbour").select("id", "neighbour", "cosine")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.filter(F.col("rank") <= k)
