import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import dedup_history as H


def naive(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edits_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        a = [r.randint(0, 5) for _ in range(r.randint(0, 14))]
        b = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = [r.randint(0, 5)] * r.randint(0, 1)
        d = naive(a, b)
        for most in (0, 1, 3, 6):
            assert H.edits(np.array(a), np.array(b), most) == (d if d <= most else most + 1)


def test_near_equal_texts_share_fingerprints():
    r = random.Random(2)
    vocabulary = ["the", "and", "queue", "of"] * 3 + [f"w{i}" for i in range(40)] + [f"identifier{i}" for i in range(40)]
    for _ in range(300):
        n = r.randint(10, 150)
        a = [r.choice(vocabulary) for _ in range(n)]
        if r.random() < 0.4:  # texts that repeat themselves have few distinct shingles
            a = (a[: r.randint(1, 12)] * n)[:n]
        b = list(a)
        for at in r.sample(range(n), n // 10):
            b[at] = r.choice(["changed", a[0], f"new{at}"])
        got = next(H._shape(iter([pa.RecordBatch.from_pydict({"id": ["a", "b"], "at": [0, 1], "content": [" ".join(a), " ".join(b)]})]))).to_pandas()
        common = len(set(got["fps"].iloc[0]) & set(got["fps"].iloc[1]))
        assert common >= (1 if got["few"].all() else 2)


def test_bloom_has_what_was_added():
    x = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    b = H.Bloom.sized(4000)
    b.add(x[:4000])
    assert b.has(x[:4000]).all() and b.has(x[4000:]).mean() < 0.05


def brute(rows):
    accepted, out = [], {}
    for at, i, c in sorted((at, i, c) for i, at, c in rows):
        w = H.words_of(c)
        if not w or i in out or any(i == x[0] for x in accepted):
            continue
        near = [(e, a, j) for j, a, v in accepted if (e := naive(w, v)) <= max(len(w), len(v)) // 10]
        if near:
            out[i] = min(near)[2]
        else:
            accepted.append((i, at, w))
    return out


@pytest.mark.parametrize("paired,batches", [(512, 2), (512, 5), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, paired, batches):
    monkeypatch.setattr(H, "PAIRED_GROUP", paired)
    r = random.Random(4)
    base = [[r.choice([f"word{i}" for i in range(60)] + ["the", "of"]) for _ in range(r.choice([3, 9, 11, 25, 60]))] for _ in range(25)]
    rows = []
    for k in range(160):
        w = list(r.choice(base[:6] if k % 3 else base))
        for _ in range(r.randint(0, 4)):
            if len(w) > 4:
                w[r.randrange(len(w))] = r.choice(["alpha", "beta", "gamma", f"x{k}"])
        text = " ".join(w)
        rows.append((f"id{k:03d}", r.randint(0, 50), r.choice([text, text.upper(), text + " !", text.replace(" ", "\n")])))
    rows += [(f"copy{k:03d}", r.randint(10, 50), rows[0][2]) for k in range(60)]
    extra = [("none", 1, None), ("empty", 1, ""), ("blank", 2, " - !"), (None, 3, rows[0][2]), rows[5]]
    df = spark.createDataFrame([(*x, 1) for x in [*rows, *extra]], "id string, at_s int, content string, k int").withColumn("t", F.timestamp_seconds("at_s").cast("timestamp_ntz"))
    got = {x["id"]: x["accepted_id"] for x in H.deduplicate(df, "id", "content", "t", batches).collect()}
    assert got == brute(rows)


def test_long_and_missing(spark):
    long = " ".join(f"token{i}" for i in range(20_000))
    df = spark.createDataFrame([("a", 1, long), ("b", 2, long.replace("token77 ", "")), ("c", None, "x y z")], "id string, t int, content string").withColumn("t", F.timestamp_seconds("t").cast("timestamp_ntz"))
    assert [(x["id"], x["accepted_id"]) for x in H.deduplicate(df, "id", "content", "t").collect()] == [("b", "a")]
    assert H.deduplicate(df.limit(0), "id", "content", "t").count() == 0


def test_few_texts_meet_by_one_big_fingerprint_of_an_earlier_batch(spark):
    # 40 texts of ten words with one ending; later copies with the fifth word changed share no other shingle
    ending = "closes the ticket as agreed"
    rows = [(f"a{i:02d}", i, " ".join(f"w{i}x{j}" for j in range(5)) + " " + ending) for i in range(40)]
    rows += [(f"b{i:02d}", 100 + i, rows[i][2].replace(f"w{i}x4", f"changed{i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, at_s int, content string").withColumn("t", F.timestamp_seconds("at_s").cast("timestamp_ntz"))
    got = {x["id"]: x["accepted_id"] for x in H.deduplicate(df, "id", "content", "t", 2).collect()}
    assert got == {f"b{i:02d}": f"a{i:02d}" for i in range(40)} == brute(rows)


def shared_ending(n, common):
    """Texts of ten words, of which the first five are common: over 32 share a fingerprint."""
    rows = [(f"a{i:02d}", i, f"{common} " + " ".join(f"w{i}x{j}" for j in range(5))) for i in range(n)]
    return [*rows, ("z", 1000, rows[7][2].replace("w7x2", "other"))]


@pytest.mark.parametrize("sharers", [20, 40])
def test_short_texts_with_one_common_beginning(spark, sharers):
    rows = shared_ending(sharers, "this release of our service")
    df = spark.createDataFrame(rows, "id string, at_s int, content string").withColumn("t", F.timestamp_seconds("at_s").cast("timestamp_ntz"))
    for batches in (1, 2, 5):
        assert [(x["id"], x["accepted_id"], x["edits"]) for x in H.deduplicate(df, "id", "content", "t", batches).collect()] == [("z", "a07", 1)]


def test_many_batches_into_a_history_that_is_opened_again(spark, tmp_path):
    """32 batches, each through a History object of its own; brute force is met, filters grow by levels, partitions stay those of the folder."""
    r = random.Random(9)
    rows = shared_ending(40, "this release of our service")
    rows += [(f"m{k:03d}", 20 * k, " ".join(r.choice(["alpha", "beta"]) + str(r.randint(0, 9)) for _ in range(12))) for k in range(60)]
    rows += [(f"n{k:03d}", 1001 + k, rows[41 + k][2].upper() + ("" if k % 2 else " x")) for k in range(60)]
    rows = sorted(rows, key=lambda x: (x[1], x[0]))
    size = -(-len(rows) // 32)
    got = {}
    path = f"file://{tmp_path}/history"
    for b in range(32):
        part = rows[b * size : (b + 1) * size]
        if not part:
            continue
        history = H.History(spark, path, partitions=4 if b == 0 else 64)
        assert history.partitions == 4 and history.batches == b
        df = spark.createDataFrame(part, "id string, at long, content string")
        got |= {x["id"]: x["accepted_id"] for x in history.add(df).collect()}
    assert got == brute(rows)


def test_a_batch_that_died_is_overwritten(spark, tmp_path):
    path = f"file://{tmp_path}/history"
    one = spark.createDataFrame([("a", 1, "one two three four five six seven eight nine ten")], "id string, at long, content string")
    H.History(spark, path).add(one)
    two = spark.createDataFrame([("b", 2, "One two three four five six seven eight nine ten")], "id string, at long, content string")
    (tmp_path / "history" / "accepted" / "batch=1").mkdir()
    (tmp_path / "history" / "prints" / "batch=1").mkdir()
    assert [tuple(x) for x in H.History(spark, path).add(two).collect()] == [("b", "a", 0)]
    # the same batch again finds the copies it made
    assert H.History(spark, path).batches == 2


def test_house_style_brings_few_candidates(spark, monkeypatch):
    """Texts that have long phrases in common, and long words of a small stock, are not all held against each other, within a batch or across two."""
    r = random.Random(6)
    stock = [f"identifier_of_{a}_{b}" for a in ("queue", "window", "review", "ledger") for b in ("owner", "handle", "prefix", "suffix")]
    rows = []
    for k in range(400):
        own = " ".join(r.choice(stock) for _ in range(2)) + " " + " ".join(f"#{r.randrange(10**9):09d}" for _ in range(3))
        rows.append((f"t{k:03d}", k, f"Repository maintainers acknowledged infrastructure responsibilities concerning {own} whenever authentication configuration specifications deteriorated"))
    rows += [(f"u{k:03d}", 1000 + k, rows[k][2].replace("whenever", "after")) for k in range(0, 400, 40)]
    pairs, before = [], H._verify
    monkeypatch.setattr(H, "_verify", lambda p, *texts: [pairs.append(p.count()), before(p, *texts)][1])
    df = spark.createDataFrame(rows, "id string, at_s int, content string").withColumn("t", F.timestamp_seconds("at_s").cast("timestamp_ntz"))
    for batches in (1, 2):
        got = {x["id"]: x["accepted_id"] for x in H.deduplicate(df, "id", "content", "t", batches).collect()}
        assert got == {f"u{k:03d}": f"t{k:03d}" for k in range(0, 400, 40)}
    assert sum(pairs) < 2 * len(rows)
