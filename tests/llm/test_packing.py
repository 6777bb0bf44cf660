import random

from loomgraph.llm import packing


def test_pack_is_whole_and_tight():
    r = random.Random(3)
    for seed in range(30):
        items = [(r.randint(1, 100), i) for i in range(r.randint(0, 300))]
        bins = packing.pack(items, 100)
        assert sorted(x for b in bins for x in b) == sorted(items)
        assert all(0 < sum(s for s, _ in b) <= 100 for b in bins)
        if len(items) > 150:
            assert len(bins) <= -(-sum(s for s, _ in items) // 100) * 1.03 + 2


def test_two_for_one_fills_a_gap():
    # greedily 60 + 30 leave 10; without the 30, 25 + 15 leave nothing
    bins = packing.pack([(60, "a"), (30, "b"), (25, "x"), (15, "y")], 100)
    assert sorted(s for s, _ in bins[0]) == [15, 25, 60] and bins[1] == [(30, "b")]
    pool = packing.Pool([(5, 1), (5, 2), (7, 3)])
    assert pool.pair(10) == (5, 5) and pool.pair(13) in ((5, 7), (7, 5)) and pool.pair(4) is None
    pool.take(5)
    assert pool.pair(10) is None


def test_documents(spark):
    texts = ["alpha beta gamma " * k for k in (1, 2, 3, 40, 400)] + [None, "", "x" * 30_000]
    df = spark.createDataFrame([*[(i, t, 0) for i, t in enumerate(texts)], (0, texts[0], 0), (None, "t", 0)], "doc_id long, text string, shard int")
    count = len(packing.encoder(packing.tokenizer_path()).encode_ordinary(texts[4]))
    rows = packing.pack_documents(df, [("s", 64), ("l", 100_000)]).collect()
    for name, cap in (("s", 64), ("l", 100_000)):
        mine = [r for r in rows if r["budget_name"] == name]
        used, spans = {}, {}
        for r in mine:
            if r["container"] >= 0:
                used[r["shard"], r["container"]] = used.get((r["shard"], r["container"]), 0) + r["token_to"] - r["token_from"]
                spans.setdefault(r["doc_id"], []).append((r["token_from"], r["token_to"], r["n_tokens"]))
        assert max(used.values()) <= cap
        for d, s in spans.items():
            s.sort()
            assert s[0][0] == 0 and s[-1][1] == s[0][2] and all(a[1] == b[0] for a, b in zip(s, s[1:]))
            assert len(s) == 1 or s[0][2] > cap
        assert spans[4][0][2] == count and {r["doc_id"] for r in mine if r["container"] < 0} == {5, 6}
    assert packing.pack_documents(df.limit(0), [("s", 64)]).count() == 0
