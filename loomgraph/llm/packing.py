"""Documents into containers of fixed token capacity by best-two-fit, in independent shards.

Each document is measured once with a public tokenizer. Documents longer than a capacity are cut into full containers and a
rest, which is packed like any other document; no other document is cut. A shard (a hash range of document ids, thousands of
documents) is packed by one task:

1. a container is filled greedily: the largest document left, then again and again the largest that still fits;
2. two for one: if space is left, its smallest document makes way for the two unpacked ones that fill the widened gap most
   tightly, if that is tighter than before; the one taken out returns to the unpacked.

Null and empty texts have no tokens and are given container -1. Documents without an id are skipped; repeated ids are one document.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Documents one task packs; what a shard wastes is at most one container that stays part empty.
SHARD_DOCS = 4_000
#: Tasks the shards are spread over at most; beyond it a task packs several, one after the other.
MAX_TASKS = 20_000

def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """(doc_id, n_tokens); texts travel to Python once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    rows = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long")


class Pool:
    """Unpacked documents by size. Sizes are at most the capacity, so searches run over distinct sizes, however many documents there are."""

    def __init__(self, items: list[tuple[int, object]]):
        self.names: dict[int, list] = {}
        for size, name in sorted(items, reverse=True):
            self.names.setdefault(size, []).append(name)
        self.sizes = sorted(self.names)

    def take(self, size: int) -> object:
        names = self.names[size]
        name = names.pop()
        if not names:
            del self.names[size]
            self.sizes.pop(bisect_left(self.sizes, size))
        return name

    def put(self, size: int, name: object) -> None:
        if size not in self.names:
            insort(self.sizes, size)
        self.names.setdefault(size, []).append(name)

    def largest(self, room: int) -> int:
        """The largest size up to room, 0 if there is none."""
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def pair(self, room: int) -> tuple[int, int] | None:
        """The two sizes of greatest sum up to room."""
        d = np.array(self.sizes[: bisect_right(self.sizes, room)])
        if not len(d):
            return None
        j = np.searchsorted(d, room - d, "right") - 1
        i = np.arange(len(d))
        # two of one size need two documents of it; else the next smaller size is taken
        single = (j == i) & np.array([len(self.names[x]) < 2 for x in d.tolist()])
        j = np.where(single, j - 1, j)
        total = np.where(j >= 0, d + d[j], 0)
        best = int(total.argmax())
        return (int(d[best]), int(d[j[best]])) if total[best] else None


def pack(items: list[tuple[int, object]], capacity: int) -> list[list[tuple[int, object]]]:
    """Bins of (size, name) with sizes 1..capacity; all items are packed, none is cut."""
    pool, bins = Pool(items), []
    while pool.sizes:
        bin_, room = [], capacity
        while size := pool.largest(room):
            bin_.append((size, pool.take(size)))
            room -= size
        if room and len(bin_) > 1:
            size, name = bin_[-1]  # filled largest first, so the last is the smallest
            two = pool.pair(room + size)
            if two and sum(two) > size:
                bin_.pop()
                bin_ += [(x, pool.take(x)) for x in two]
                pool.put(size, name)
        bins.append(bin_)
    return bins


PACKED = "budget_name string, shard int, container int, doc_id long, piece int, token_from long, token_to long, capacity int, n_tokens long"


def _pack_shards(budgets: list[tuple[str, int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def shard_rows(shard: int, docs: list[tuple[int, int]]) -> pd.DataFrame:
        rows = []
        for name, capacity in budgets:
            items, full = [], 0
            for doc, n in docs:
                piece = at = 0
                while n - at > capacity:
                    rows.append((name, shard, full, doc, piece, at, at + capacity, capacity, n))
                    full, piece, at = full + 1, piece + 1, at + capacity
                if n:
                    items.append((n - at, (doc, piece, at, n)))
                else:
                    rows.append((name, shard, -1, doc, 0, 0, 0, capacity, 0))
            for b, members in enumerate(pack(items, capacity)):
                rows += [(name, shard, full + b, doc, piece, at, at + size, capacity, n) for size, (doc, piece, at, n) in members]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, docs = None, []
        for pdf in batches:
            for s, d, n in zip(pdf["shard"].tolist(), pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()):
                if s != now:
                    if docs:
                        yield shard_rows(now, docs)
                    now, docs = s, []
                docs.append((d, n))
        if docs:
            yield shard_rows(now, docs)

    return run


def pack_documents(documents: DataFrame, budgets: list[tuple[str, int]], doc_id: str = "doc_id", text: str = "text", path: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each document piece and budget: its container (shard, container) and the token range it holds there."""
    budgets = [(n, int(c)) for n, c in budgets if c and c > 0]
    # the number of documents comes from file footers, not from a scan of the texts
    shards = max(1, -(-documents.select(doc_id).count() // shard_docs))
    counted = token_counts(documents, doc_id, text, path or tokenizer_path()).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    sharded = counted.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n_tokens")
    # few rows, much work: a number of its own, which adaptive execution leaves alone
    return sharded.repartition(min(4 * shards, MAX_TASKS), "shard").sortWithinPartitions("shard", "doc_id").mapInPandas(_pack_shards(budgets), PACKED)
