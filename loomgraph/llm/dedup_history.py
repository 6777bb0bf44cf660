"""New batches against all accepted history: partitioned Bloom filters over winnowed fingerprints, a persistent fingerprint
store for what the filters let through, and verification of the shared words.

Near-equal: word edits (insert, delete, replace) at most a tenth of the longer text's words; words are split at white space and
compared in lower case without punctuation. Texts under ten words are therefore near-equal only if equal.

Nothing near-equal is missed by the fingerprints. They are single words, a repeated one told apart by how often it came before, so
each of k edits changes at most one of a text's n: of two near-equal texts at least n - k are common. All words are put into one
fixed order, and each text is winnowed to the first k + 2 of them; the two first common ones are then among these in both texts. Long
words and words with digits come first in the order, as they are rare; words of the house style, which form huge groups, are what
falls away. (Winnowing by small windows was tried: it must keep a pick from every window, also from those that hold nothing but such
words. So were shingles of five words: an edit changes five, so 5 k + 2 are kept, and these reach into the phrases of the house style.)

Rows without an id, and null or wordless contents, are no episodes here. Repeated ids are one episode. A null time sorts last. Ties
go by id. Of several accepted partners the one with the fewest edits, then the earliest, is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Cut, bounded, delete, new_path

PARTITIONS = 64
#: Texts of fewer words are near-equal only if equal.
LEAST_WORDS = 9
BITS, HASHES = 12, 4
#: Fingerprints the first Bloom filter of a partition is made for; each further one takes four times as many.
FIRST = 1 << 12
#: Groups of more texts than this that share a fingerprint are big: their texts meet only if they share a second fingerprint, so by the twos of them.
SMALL_GROUP = 32
#: Texts with the same two big fingerprints meet in pairs up to this size, and leader by leader beyond it.
PAIRED_GROUP = 512
_DROP = re.compile(r"[^\w\s]|_")


def words_of(text: str) -> list[str]:
    return _DROP.sub("", text.lower()).split()


def allowed(n: int) -> int:
    return n // 10


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance, or most + 1 if it is larger: furthest-reaching points on each diagonal, in O(most * words)."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    x, y = a.tolist(), b.tolist()
    p, q = set(x), set(y)
    if len(p - q) > most or len(q - p) > most:  # each word without a counterpart costs an edit
        return most + 1

    def slide(i: int, j: int) -> int:
        while i < n and j < m and x[i] == y[j]:
            i += 1
            j += 1
        return i

    reach = {0: slide(0, 0)}
    for e in range(most + 1):
        if reach.get(n - m, -1) >= n:
            return e
        grown = {}
        for d in range(-e - 1, e + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -2))
            if i >= 0 and i - d >= 0:
                i = min(i, n, m + d)
                grown[d] = slide(i, i - d)
        reach = grown
    return most + 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def most_edits(n: np.ndarray) -> np.ndarray:
    """The edits that a near-equal text of n / 0.9 words, the longest there can be, may have."""
    return (n * 10 // 9) // 10


def fingerprints(lengths: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, fingerprint) for texts laid end to end, and for each text whether it is too short to have any; words of great weight come first."""
    few = lengths < LEAST_WORDS
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    by = np.lexsort((hashes, doc))
    h, weight = hashes[by], weights[by]
    # texts follow one another as before, so doc and starts still hold
    fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
    again = np.arange(len(h)) - np.repeat(fresh, np.diff(np.append(fresh, len(h))))
    h = _mix(h + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = h[np.lexsort((h, -weight, doc))]
    use = (np.arange(len(h)) - starts[doc] < most_edits(lengths)[doc] + 2) & ~few[doc]
    return doc[use], h[use], few


SHAPE = "id string, at long, cls binary, n int, few boolean, words binary, fps array<long>"
#: Numbers of texts: the batch in the upper bits, Spark's own row number below.
BATCH_BITS = 50


def _shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, at, content) -> SHAPE; columns are laid out as Arrow buffers, without a Python object for each row."""
    for batch in batches:
        texts = [words_of(t) for t in batch.column(2).to_pylist()]
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = [w for t in texts for w in t]
        codes, uniques = pd.factorize(np.array(flat, object))
        own = pd.util.hash_array(np.array(uniques, object), categorize=False) if len(uniques) else np.zeros(0, np.uint64)
        weights = np.array([min(len(u), 24) + 2 * sum(c.isdigit() for c in u) for u in uniques], np.int64)
        hashes = own[codes] if len(codes) else np.zeros(0, np.uint64)
        docs, fps, few = fingerprints(lengths, hashes, weights[codes] if len(codes) else np.zeros(0, np.int64))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        cuts = np.searchsorted(docs, np.arange(len(texts) + 1)).astype(np.int32)
        raw = hashes.tobytes()
        cls = [hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        words = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(short.tobytes())])
        found = pa.ListArray.from_arrays(pa.array(cuts), pa.array(fps.astype(np.int64)))
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(lengths.astype(np.int32)), pa.array(few), words, found], names=["id", "at", "cls", "n", "few", "words", "fps"])
        yield out.filter(pa.array(lengths > 0))


def _parted(partitions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(k, fps) -> one row for each partition of fingerprints and batch, its numbers side by side in blobs: a shuffle of few, long rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = np.diff(lists.offsets.to_numpy())
            fp = lists.flatten().to_numpy(zero_copy_only=False)
            k = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            part = fp.view(np.uint64) % np.uint64(partitions)
            by = np.lexsort((fp, part))
            part, fp, k = part[by], fp[by], k[by]
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
            blobs = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (fp, k)]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in spans], pa.int32()), *blobs], names=["part", "fps", "ks"])

    return run


class Bloom:
    """Plain Bloom filter over 64-bit fingerprints, by double hashing."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def sized(cls, n: int) -> Bloom:
        return cls(np.zeros(max(64, n * BITS) // 8 + 1, np.uint8))

    def _places(self, fps: np.ndarray) -> Iterator[np.ndarray]:
        a, b = _mix(fps ^ np.uint64(0x51ED270B)), _mix(fps ^ np.uint64(0xA24BAED4)) | np.uint64(1)
        for i in range(HASHES):
            yield (a + np.uint64(i) * b) % np.uint64(len(self.bits) * 8)

    def add(self, fps: np.ndarray) -> None:
        for p in self._places(fps):
            np.bitwise_or.at(self.bits, p >> np.uint64(3), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, fps: np.ndarray) -> np.ndarray:
        out = np.ones(len(fps), bool)
        for p in self._places(fps):
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


BLOBS = "part int, fps binary, ks binary"
SCREEN = "kind string, part int, fp long, k long, k2 long, bits binary"


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, fps, ks, bits, level, n), blobs of fingerprints or a filter, partition by partition: 'pair' and 'big' rows share a
    fingerprint within the batch, the 'old' row holds what may be in history (fps, then ks, in one blob), the 'bits' rows the filters with the batch added.

    A partition's filters have capacities that grow fourfold; only the last takes more, so there are few however long the history.
    """

    def flush(part: int, filters: dict[int, tuple[int, bytes]], fps: list, ks: list) -> pa.RecordBatch:
        fp, k = np.concatenate(fps), np.concatenate(ks)
        u = fp.view(np.uint64)
        hit = np.zeros(len(u), bool)
        for _, bits in filters.values():
            hit |= Bloom(np.frombuffer(bits, np.uint8)).has(u)
        level = max(filters, default=-1)
        n, own = filters[level][0] if filters else 0, None
        if not filters or n + len(u) > FIRST << 2 * level:
            level, n = next(x for x in range(level + 1, 99) if len(u) <= FIRST << 2 * x), 0
            own = Bloom.sized(FIRST << 2 * level)
        else:
            own = Bloom(np.frombuffer(filters[level][1], np.uint8).copy())
        own.add(u)
        filters = {**filters, level: (n + len(u), own.bits.tobytes())}
        by = np.lexsort((k, fp))
        fp, k, hit = fp[by], k[by], hit[by]
        edge = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1], [True])))
        size = np.diff(edge)
        lower, upper, big = [], [], []
        for a, m in zip(edge[:-1][size > 1].tolist(), size[size > 1].tolist()):
            if m <= SMALL_GROUP:
                i, j = np.triu_indices(m, 1)
                lower.append(a + i)
                upper.append(a + j)
            else:
                big.append(np.arange(a, a + m))
        none = np.zeros(0, np.int64)
        lower, upper, big = (np.concatenate(x) if x else none for x in (lower, upper, big))
        one, tail = np.concatenate((lower, big)), len(filters) + 1
        gap = [None] * len(one)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["pair"] * len(lower) + ["big"] * len(big) + ["old"] + ["bits"] * len(filters)),
                pa.array(np.full(len(one) + tail, part, np.int32)),
                pa.array([*fp[one].tolist(), int(hit.sum()), *filters], pa.int64()),
                pa.array([*k[one].tolist(), 0, *(m for m, _ in filters.values())], pa.int64()),
                pa.array([*k[upper].tolist(), *[None] * (len(big) + tail)], pa.int64()),
                pa.array([*gap, fp[hit].tobytes() + k[hit].tobytes(), *(x for _, x in filters.values())], pa.binary()),
            ],
            names=[c.split()[0] for c in SCREEN.split(", ")],
        )

    # a task holds its partitions whole, 16 bytes a fingerprint
    held: dict[int, tuple[dict, list, list]] = {}
    for batch in batches:
        for part, fps, ks, bits, level, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
            own = held.setdefault(part, ({}, [], []))
            if bits is not None:
                own[0][level] = (n, bits)
            else:
                own[1].append(np.frombuffer(fps, np.int64))
                own[2].append(np.frombuffer(ks, np.int64))
    for part in list(held):
        filters, fps, ks = held.pop(part)
        if fps:
            yield flush(part, filters, fps, ks)
        else:  # a partition the batch has nothing for keeps its filters
            n = len(filters)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["bits"] * n), pa.array(np.full(n, part, np.int32)), pa.array(list(filters), pa.int64()), pa.array([m for m, _ in filters.values()], pa.int64()), pa.array([None] * n, pa.int64()), pa.array([x for _, x in filters.values()], pa.binary())],
                names=[c.split()[0] for c in SCREEN.split(", ")],
            )


FOUND = "kind string, fp long, k long, k2 long"


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, asked, fps, ks): what a batch asks for and what the store holds, partition by partition -> 'met' pairs (k, k2) of
    fingerprints that few stored texts have; of others, which are hot, the memberships of both sides ('new' with k, 'old' with k2)."""

    def flush(asked: list[bytes], stored: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        halves = [np.frombuffer(x, np.int64) for x in asked]
        fp, k = (np.concatenate([x[: len(x) // 2] for x in halves]), np.concatenate([x[len(x) // 2 :] for x in halves]))
        by = np.argsort(fp, kind="stable")
        fp, k = fp[by], k[by]
        wanted = np.unique(fp)
        f2, k2 = [], []
        for fps, ks in stored:
            x = np.frombuffer(fps, np.int64)
            at = np.searchsorted(wanted, x)
            ok = wanted[np.minimum(at, len(wanted) - 1)] == x
            f2.append(x[ok])
            k2.append(np.frombuffer(ks, np.int64)[ok])
        f2, k2 = (np.concatenate(x) for x in (f2, k2))
        by = np.argsort(f2, kind="stable")
        f2, k2 = f2[by], k2[by]
        n = np.searchsorted(f2, fp, "right") - np.searchsorted(f2, fp)
        some = (n > 0) & (n <= SMALL_GROUP)
        lo = np.searchsorted(f2, fp[some])
        j = np.repeat(lo - np.concatenate(([0], np.cumsum(n[some])[:-1])), n[some]) + np.arange(n[some].sum())
        hot = n > SMALL_GROUP
        own = np.isin(f2, fp[hot])
        a, b, c = len(j), int(hot.sum()), int(own.sum())
        zero = lambda m: np.zeros(m, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["met"] * a + ["new"] * b + ["old"] * c, pa.string()),
                pa.array(np.concatenate((f2[j], fp[hot], f2[own]))),
                pa.array(np.concatenate((np.repeat(k[some], n[some]), k[hot], zero(c)))),
                pa.array(np.concatenate((k2[j], zero(b), k2[own]))),
            ],
            names=[c.split()[0] for c in FOUND.split(", ")],
        )

    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for part, asked, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4))):
            own = held.setdefault(part, ([], []))
            if asked is not None:
                own[0].append(asked)
            else:
                own[1].append(tuple(blobs))
    for part in list(held):
        asked, stored = held.pop(part)
        if asked and stored:
            yield from flush(asked, stored)


LINK = "k long, at long, k2 long, at2 long, edits int"


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = []
        for x, y in zip(pdf["w1"], pdf["w2"]):
            a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            most = allowed(max(len(a), len(b)))
            e = edits(a, b, most)
            got.append(e if e <= most else -1)
        out = pdf[["k", "at", "k2", "at2"]].assign(edits=np.array(got, np.int32))
        yield out[out["edits"] >= 0]


def _verify(pairs: DataFrame, texts: DataFrame, others: DataFrame) -> DataFrame:
    """The candidate pairs (k, k2) that are near-equal, the later text (by batch, time, then id) first; lengths are compared before words move."""
    left = texts.select("k", F.col("id").alias("i1"), F.col("at").alias("a1"), F.col("n").alias("n1"), F.col("words").alias("w1"))
    right = others.select(F.col("k").alias("k2"), F.col("id").alias("i2"), F.col("at").alias("a2"), F.col("n").alias("n2"), F.col("words").alias("w2"))
    rows = Cut(left.join(bounded(pairs.select("k", "k2")), "k"), "left").df
    words = rows.agg(F.sum("n1")).first()[0] or 0
    # four bytes a word: the words of one side are broadcast only if counted to be a few MB
    rows = right.join(F.broadcast(rows), "k2") if words <= 4_000_000 else rows.join(right, "k2")
    rows = rows.filter(F.abs(F.col("n1") - F.col("n2")) <= F.floor(F.greatest("n1", "n2") / 10))
    later = F.struct(F.shiftright("k", BATCH_BITS).alias("b"), "a1", "i1") > F.struct(F.shiftright("k2", BATCH_BITS).alias("b"), F.col("a2").alias("a1"), F.col("i2").alias("i1"))
    pick = lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))
    return rows.select(pick("k", "k2").alias("k"), pick("a1", "a2").alias("at"), pick("k2", "k").alias("k2"), pick("a2", "a1").alias("at2"), "w1", "w2").mapInPandas(_verified, LINK)


def _lists(rows: DataFrame, k: str) -> DataFrame:
    """(k, fps): the big fingerprints of each text."""
    return rows.groupBy(k).agg(F.collect_set("fp").alias("fps"))


def _twos(lists: DataFrame, k: str) -> DataFrame:
    """(fp, k) with a key for every two of a text's big fingerprints."""
    ones = lists.select(k, "fps", F.explode("fps").alias("a"))
    return ones.select(k, "a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b")).select(F.xxhash64("a", "b").alias("fp"), k)


def _one_more(met: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs that met only once but share a big fingerprint besides; left and right: (k, fps) and (k2, fps)."""
    once = met.filter("c = 1").select("k", "k2").join(left, "k").join(right.withColumnRenamed("fps", "fps2"), "k2")
    return once.filter(F.arrays_overlap("fps", "fps2")).select("k", "k2")


class History:
    """The persistent state in one folder, which can be opened again and again:

    - accepted: the texts with their words, a sub-folder for each batch, so that words are fetched from the batches that candidates name;
    - prints: the fingerprint store, a sub-folder for each batch and partition of fingerprints, of which a batch reads those its positives name;
    - bloom: the filters of all partitions, rewritten with each batch; at 12 bits a fingerprint, they are a hundredth of the texts;
    - classes: (digest, accepted id) of all texts met, for exact copies;
    - done: a mark for each batch that is complete. What a batch that died has left behind is overwritten by the next.
    """

    def __init__(self, spark: SparkSession, path: str, partitions: int = PARTITIONS):
        """partitions: fixed when a history is made, kept when it is opened again. A task holds at least one, 16 bytes for each fingerprint
        of a batch in it and 12 bits for each of history; 64 serve batches of some hundred million fingerprints, larger ones take more."""
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        made = [x.getPath().getName() for x in self._fs.globStatus(self._path(f"{path}/partitions=*"))]
        self.partitions = int(made[0].split("=")[1]) if made else partitions
        if not made:
            self._fs.mkdirs(self._path(f"{path}/partitions={partitions}"))
        self.batches = len(self._fs.globStatus(self._path(f"{path}/done/batch=*")))

    def _read(self, name: str, schema: str, batches: list[int] | None = None) -> DataFrame:
        """A table of the history, or of the given batches of it; empty if there are none."""
        asked = range(self.batches) if batches is None else batches
        if not asked:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/batch={i}" for i in asked])

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}/batch={self.batches}")

    def add(self, texts: DataFrame) -> DataFrame:
        """Takes (id, at, content) rows that all come after the history; gives (id, accepted_id, edits) of the duplicates."""
        number = F.monotonically_increasing_id() + F.lit(self.batches << BATCH_BITS)
        shaped_cut = Cut(texts.select("id", "at", "content").mapInArrow(_shape, SHAPE).withColumn("k", number), "shaped")
        shaped = shaped_cut.df
        # exact copies collapse to their earliest; only that one is compared any further
        firsts = shaped.groupBy("cls").agg(F.min(F.struct("at", "id", "k")).alias("first")).select("cls", "first.id", "first.k")
        known = self._read("classes", "cls binary, accepted string") if self.batches else None
        new = firsts if known is None else firsts.join(known, "cls", "left_anti")
        new = Cut(new, "new").df
        copies = bounded(Cut(shaped.select("k").join(new.select("k"), "k", "left_anti"), "copies").df)
        reps_cut = Cut(shaped.drop("cls").join(copies, "k", "left_anti"), "reps")
        reps = reps_cut.df
        # from here on only the names of the other members are needed
        members = Cut(shaped.select("id", "cls"), "members").df
        shaped_cut.drop()

        none = lambda kind: F.lit(None).cast(kind)
        blobs_cut = Cut(reps.select("k", "fps").mapInArrow(_parted(self.partitions), BLOBS), "blobs")
        rows = blobs_cut.df.select("part", "fps", "ks", none("binary").alias("bits"), none("int").alias("level"), none("long").alias("n"))
        if self.batches:
            bloom = self._read("bloom", "part int, level int, n long, bits binary", [self.batches - 1])
            rows = rows.unionByName(bloom.select("part", none("binary").alias("fps"), none("binary").alias("ks"), "bits", "level", "n"))
        screened_cut = Cut(rows.repartition("part").mapInArrow(_screen, SCREEN), "screened")
        screened = screened_cut.df

        within, leaders = self._within(screened.filter("kind = 'pair'"), screened.filter("kind = 'big'").select("fp", "k"))
        pairs, others = within, reps.select("k", "id", "at", "n", "words")
        if self.batches:
            before = self._before(screened.filter("kind = 'old' and fp > 0"))
            pairs = Cut(within.select("k", "k2").unionByName(before), "pairs").df
            named = [r[0] for r in pairs.select(F.shiftright("k2", BATCH_BITS).alias("b")).distinct().collect() if r[0] < self.batches]
            others = others.unionByName(self._read("accepted", "k long, id string, at long, n int, words binary", sorted(named)).select("k", "id", "at", "n", "words"))
        else:
            pairs = Cut(pairs, "pairs").df
        links = Cut(_verify(pairs, reps, others), "links").df
        own = F.shiftright("k2", BATCH_BITS) == self.batches
        dups = self._resolve(reps, links.filter(~own), links.filter(own), leaders)
        gone = bounded(dups.select("k"))
        self._write(reps.drop("fps", "few").join(gone, "k", "left_anti"), "accepted")
        reps_accepted = reps.select("k", "fps").join(gone, "k", "left_anti")
        self._write(reps_accepted.mapInArrow(_parted(self.partitions), BLOBS), "prints", "part")
        self._write(screened.filter("kind = 'bits'").select("part", F.col("fp").cast("int").alias("level"), F.col("k").alias("n"), "bits"), "bloom")
        # every member of a class goes with its first text, or to the accepted text that one repeats
        name = reps.select("k", "id")
        if self.batches:
            name = name.unionByName(self._read("accepted", "k long, id string", sorted(named)).select("k", "id"))
        named_dups = dups.join(name.select(F.col("k").alias("k2"), F.col("id").alias("accepted")), "k2").select("k", "accepted", "edits")
        outcome = new.join(named_dups, "k", "left").select("cls", F.coalesce("accepted", "id").alias("accepted"), F.coalesce("edits", F.lit(0)).alias("edits"))
        outcome = Cut(outcome, "outcome").df
        self._write(outcome.select("cls", "accepted"), "classes")
        if known is not None:
            again = members.select("cls").distinct().join(known, "cls")
            outcome = outcome.unionByName(again.select("cls", "accepted", F.lit(0).alias("edits")))
        found = members.join(outcome, "cls").filter("id <> accepted").select("id", F.col("accepted").alias("accepted_id"), "edits")
        found = Cut(found.distinct(), "found").df
        self._fs.mkdirs(self._path(f"{self.path}/done/batch={self.batches}"))
        if self.batches > 1:  # the filters before the last are kept until the batch is complete
            delete(self.spark, f"{self.path}/bloom/batch={self.batches - 2}")
        self.batches += 1
        for used in (reps_cut, blobs_cut, screened_cut):
            used.drop()
        return found

    def _within(self, pair: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Candidate pairs inside the batch, and the memberships (fp, k) of groups too large for pairs, if there are any.

        Near-equal texts share two fingerprints at least: both in small groups, one in a small and one in a big group, or a two of big ones.
        """
        met = Cut(pair.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("c")), "met").df
        pairs = met.filter("c > 1").select("k", "k2")
        if big.isEmpty():
            return pairs, None
        lists = Cut(_lists(big, "k"), "big").df
        twos = Cut(_twos(lists, "k"), "twos").df
        sizes = twos.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        left = twos.join(sizes.filter(F.col("c") <= PAIRED_GROUP).select("fp"), "fp", "left_semi")
        paired = left.join(left.withColumnRenamed("k", "k2"), "fp").filter("k < k2").select("k", "k2")
        pairs = pairs.union(_one_more(met, lists, lists.withColumnRenamed("k", "k2"))).union(paired).distinct()
        leaders = Cut(twos.join(sizes.filter(F.col("c") > PAIRED_GROUP).select("fp"), "fp", "left_semi"), "leaders").df
        return pairs, None if leaders.isEmpty() else leaders

    def _before(self, asked: DataFrame) -> DataFrame:
        """Candidate pairs of the batch's texts with accepted ones: filter positives looked up in the partitions of the store they name."""
        none = F.lit(None).cast("binary")
        parts = [r[0] for r in asked.select("part").collect()]  # at most as many as there are partitions
        if not parts:
            return self.spark.createDataFrame([], "k long, k2 long")
        store = self._read("prints", f"batch int, {BLOBS}").filter(F.col("part").isin(parts)).select("part", none.alias("asked"), "fps", "ks")
        rows = asked.select("part", F.col("bits").alias("asked"), none.alias("fps"), none.alias("ks")).unionByName(store)
        looked = Cut(rows.repartition("part").mapInArrow(_look_up, FOUND), "looked").df
        met = Cut(looked.filter("kind = 'met'").groupBy("k", "k2").agg(F.count(F.lit(1)).alias("c")), "met").df
        pairs = met.filter("c > 1").select("k", "k2")
        hot = looked.filter("kind = 'new'")
        if hot.isEmpty():
            return pairs
        new = Cut(_lists(hot, "k"), "new").df
        old = Cut(_lists(looked.filter("kind = 'old'"), "k2"), "old").df
        both = _twos(new, "k").join(_twos(old, "k2"), "fp").select("k", "k2")
        return pairs.union(_one_more(met, new, old)).union(both).distinct()

    def _resolve(self, reps: DataFrame, against: DataFrame, links: DataFrame, big: DataFrame | None) -> DataFrame:
        """(k, k2: the accepted text it repeats, edits). A text whose earlier near-equals are all settled is settled itself.

        Texts in groups that share a fingerprint too often for pairs are compared with the group's earliest unsettled text
        only, round by round; that one is settled in its round, so each later text meets every accepted one before it is.
        """
        best = lambda df: df.groupBy("k").agg(F.min(F.struct("edits", "at2", "k2")).alias("b")).select("k", "b.k2", "b.edits")
        without = lambda df, gone, *columns: [df := df.join(gone.select(F.col("k").alias(c)), c, "left_anti") for c in columns][-1]
        parts = Cut(best(against), "dups").df
        edges = Cut(without(links, parts, "k", "k2"), "edges").df
        open_ = None if big is None else without(big, parts, "k")
        leaders = open_ is not None and not open_.isEmpty()
        while leaders or not edges.isEmpty():
            near = edges
            alive, waiting = edges.select("k").union(edges.select("k2")), edges.select("k")
            if leaders:
                times = reps.select("k", "at", "id")
                timed = Cut(open_.join(times, "k"), "open").df
                first = timed.groupBy("fp").agg(F.min(F.struct("at", "id", "k")).alias("m")).select("fp", F.col("m.k").alias("k2"))
                behind = timed.join(first, "fp").filter("k <> k2").select("k", "k2").distinct()
                near = near.unionByName(Cut(_verify(behind, reps, reps), "near").df)
                alive, waiting = alive.union(timed.select("k")), waiting.union(behind.select("k"))
            # earliest of all they meet: accepted for sure
            settled = Cut(without(alive.distinct(), waiting.distinct(), "k"), "settled").df
            now = Cut(best(near.join(settled.withColumnRenamed("k", "k2"), "k2")), "dups").df
            parts = parts.unionByName(now)
            done = now.select("k").union(settled)
            edges = Cut(without(without(edges, now, "k"), done, "k2"), "edges").df
            if leaders:
                open_ = Cut(without(open_, done, "k"), "open").df
                leaders = not open_.isEmpty()
        return parts


def deduplicate(episodes: DataFrame, id: str, content: str, order: str, batches: int = 4, partitions: int = PARTITIONS, bounds: list[int] | None = None, path: str | None = None) -> DataFrame:
    """(id, accepted_id, edits) of all duplicates, feeding the rows to a fresh history in consecutive batches of the order column.

    bounds: the last microsecond of each batch but the last; else the rows are cut into equal parts. path: where the history is made and stays;
    else it is deleted. The outcome does not depend on the batches: texts are settled strictly in order.
    """
    spark = episodes.sparkSession
    us = F.unix_micros(F.col(order).cast("timestamp"))
    rows = episodes.filter(F.col(id).isNotNull() & F.col(content).isNotNull())
    if bounds is None:
        bounds = rows.agg(F.percentile_approx(us, [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    bounds = sorted(set(bounds))
    history = History(spark, path or new_path(spark, "history"), partitions)
    out = None
    kind = dict(episodes.dtypes)[order]
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        part = rows
        # plain comparisons of the column, so that row groups of other batches are skipped by their statistics
        if lo is not None:
            later = F.col(order) > F.timestamp_micros(F.lit(lo)).cast(kind)
            part = part.filter(later if hi is not None else later | F.col(order).isNull())
        if hi is not None:
            part = part.filter(F.col(order) <= F.timestamp_micros(F.lit(hi)).cast(kind))
        found = history.add(part.select(F.col(id).alias("id"), F.coalesce(us, F.lit(2**62)).alias("at"), F.col(content).alias("content")))
        out = found if out is None else out.unionByName(found)
    if path is None:
        delete(spark, history.path)
    return out
