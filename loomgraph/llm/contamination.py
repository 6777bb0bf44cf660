"""Held-out passages inside a training corpus, found in an FM-index of each training shard.

A shard is what one task reads. Words are maximal runs of letters and digits in lower case. A common run of n words (ten by
default) consists of passage words only, so of a shard's text only runs of at least n passage words can matter; just these, parted
by a separator, are indexed: Burrows-Wheeler transform in a wavelet matrix, symbol counts, and sampled suffix positions.
Every n-word phrase of the passages is searched backwards, all phrases at a time; occurrences are located by walking to the next
sampled suffix, and the spans of one document and item that touch are merged into removal spans.

Null and wordless texts hold nothing; passages of fewer than n words cannot be found; repeated rows give repeated hits once;
documents without an id are skipped. Passages are taken in blocks, so what is sent to tasks stays bounded however many there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
PHRASE = 10
SAMPLE = 8
#: Indexed words after which a shard is searched and a new one begun.
SHARD_WORDS = 500_000
#: Passages sent to the tasks at once.
BLOCK = 5_000


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling: sort by pairs of ranks of 1, 2, 4, ... symbols."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols; get(i): the symbol there. Both take arrays."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for k in range(self.depth):
            one = ((c >> (self.depth - 1 - k)) & 1) == 1
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.depth):
            a = self.ones[k][i]
            one = self.ones[k][i + 1] > a
            out = out * 2 + one
            i = np.where(one, self.zeros[k] + a, i - a)
        return out


class FMIndex:
    """Over symbols >= 1; 0 is the end mark."""

    def __init__(self, symbols: np.ndarray):
        s = np.concatenate((symbols, [0])).astype(np.int64)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.n = len(s)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s))))
        self.tree = WaveletMatrix(bwt)
        kept = sa % SAMPLE == 0
        self.kept, self.kept_before = kept, np.concatenate(([0], np.cumsum(kept)))
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases, one in each row; empty where there is no occurrence."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            known = c < len(self.before) - 1
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        done = np.zeros(len(phrases), bool)
        done[live] = True
        return np.where(done, low, 0), np.where(done, high, 0)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, each walked left to the next sampled one."""
        out, steps, todo = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.astype(np.int64).copy()
        while len(todo):
            hit = self.kept[at[todo]]
            done = todo[hit]
            out[done] = self.samples[self.kept_before[at[done]]] + steps[done]
            todo = todo[~hit]
            if len(todo):
                c = self.tree.get(at[todo])
                at[todo] = self.before[c] + self.tree.rank(c, at[todo])
                steps[todo] += 1
        return out


class Passages:
    """The vocabulary of the passages and their distinct phrases, each with the items that hold it."""

    def __init__(self, items: list[tuple[int, str]], phrase: int = PHRASE):
        self.phrase, self.ids = phrase, {}
        rows, owners = {}, []
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 2) for x in WORD.findall((text or "").lower())]  # 0 end mark, 1 separator
            for i in range(len(w) - phrase + 1):
                owners.append((rows.setdefault(tuple(w[i : i + phrase]), len(rows)), item))
        self.phrases = np.array(list(rows), np.int64).reshape(len(rows), phrase)
        pairs = np.array(sorted(set(owners)), np.int64).reshape(-1, 2)
        self.items = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))


SPANS = "doc_id long, item_id long, char_from int, char_to int, n_words int"


def _search(passages: Passages) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    n, get = passages.phrase, passages.ids.get

    def spans(shard: list[tuple[np.ndarray, np.ndarray, np.ndarray]], texts: dict[int, list[str]]) -> pd.DataFrame:
        symbols, docs, words = (np.concatenate(x) for x in zip(*shard))
        index = FMIndex(symbols)
        low, high = index.search(passages.phrases)
        hit = np.flatnonzero(high > low)
        count = high[hit] - low[hit]
        at = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        where, phrase = index.locate(at), np.repeat(hit, count)
        k = passages.first[phrase + 1] - passages.first[phrase]
        item = passages.items[np.repeat(passages.first[phrase] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())]
        doc, word = docs[np.repeat(where, k)], words[np.repeat(where, k)]
        by = np.lexsort((word, item, doc))
        doc, item, word = doc[by], item[by], word[by]
        # words up to n apart lie in spans that overlap or touch
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + n)
        a = np.flatnonzero(new)
        b = np.concatenate((a[1:], [len(doc)])) - 1
        out, seen, ends = [], None, None
        for i, j in zip(a, b):
            if doc[i] != seen:
                seen = doc[i]
                ends = [(m.start(), m.end()) for m in WORD.finditer(texts[seen][1])]
            out.append((texts[seen][0], item[i], ends[word[i]][0], ends[word[j] + n - 1][1], word[j] + n - word[i]))
        return pd.DataFrame(out, columns=["doc_id", "item_id", "char_from", "char_to", "n_words"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, texts, size, number = [], {}, 0, 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                number += 1
                ids = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)
                if len(ids) < n:
                    continue
                inside = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
                edge = np.flatnonzero(np.diff(inside))
                a, b = edge[::2], edge[1::2]
                long = b - a >= n
                if not long.any():
                    continue
                for i, j in zip(a[long].tolist(), b[long].tolist()):
                    shard.append((np.concatenate((ids[i:j], [1])), np.full(j - i + 1, number), np.arange(i, j + 1)))
                    size += j - i + 1
                texts[number] = [doc_id, text]
            if size > SHARD_WORDS:
                yield spans(shard, texts)
                shard, texts, size = [], {}, 0
        if shard:
            yield spans(shard, texts)

    return run


def leaked_spans(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", phrase: int = PHRASE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, char_from, char_to, n_words): each maximal stretch of a document that an item's phrases cover."""
    spark = documents.sparkSession
    rows = documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = items.filter(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).distinct()
    out, last = spark.createDataFrame([], SPANS), None
    while True:
        part = (wanted if last is None else wanted.filter(F.col("i") > last)).orderBy("i").limit(block).collect()
        if not part:
            return out
        last = part[-1][0]
        # a block ends with all passages of its last item
        part = [r for r in part if r[0] < last] + wanted.filter(F.col("i") == last).collect()
        found = rows.mapInPandas(_search(Passages([(r[0], r[1]) for r in part], phrase)), SPANS)
        out = found if out is None else out.unionByName(found)


def removal_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, char_from, char_to, n_items): the spans of all items of a document merged where they overlap, for cutting out."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, a, b, items = None, 0, 0, set()
        for pdf in batches:
            out = []
            for d, i, x, y in zip(pdf["doc_id"], pdf["item_id"], pdf["char_from"], pdf["char_to"]):
                if d == doc and x <= b:
                    b = max(b, y)
                    items.add(i)
                    continue
                if doc is not None:
                    out.append((doc, a, b, len(items)))
                doc, a, b, items = d, x, y, {i}
            yield pd.DataFrame(out, columns=["doc_id", "char_from", "char_to", "n_items"])
        if doc is not None:
            yield pd.DataFrame([(doc, a, b, len(items))], columns=["doc_id", "char_from", "char_to", "n_items"])

    return spans.distinct().repartition("doc_id").sortWithinPartitions("doc_id", "char_from").mapInPandas(merge, "doc_id long, char_from int, char_to int, n_items int")
