import random

import numpy as np

from loomgraph.llm import contamination as C


def test_fm_index_equals_scanning():
    r = random.Random(6)
    for n in (1, 2, 17, 400):
        s = [r.randint(1, 4) for _ in range(n)]
        index = C.FMIndex(np.array(s))
        for k in (1, 2, 3, 5):
            phrases = np.array([[r.randint(1, 6) for _ in range(k)] for _ in range(40)])
            low, high = index.search(phrases)
            for p, a, b in zip(phrases.tolist(), low, high):
                want = [i for i in range(n - k + 1) if s[i : i + k] == p]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(docs, items, n=10):
    words = lambda t: C.WORD.findall((t or "").lower())
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {(d, i) for d, t, *_ in docs for i, p in items if d is not None and grams(words(t)) & grams(words(p))}


def test_documents(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([5, 10, 30])))) for i in range(12)] + [(3, "a b c d e f g h i j k"), (50, None), (51, "")]
    docs = []
    for d in range(80):
        body = [r.choice([*vocabulary, "other", "Über"]) for _ in range(30)]
        if r.random() < 0.6:
            p = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(p) - 9))
            part = p[a : a + r.randint(8, 20)]
            body[7:7] = [x.upper() if r.random() < 0.5 else x + r.choice(["", ",", " --", "\n//"]) for x in part]
        docs.append((d, " ".join(body), 0))
    docs += [(90, None, 0), (91, "", 0), (None, items[0][1], 0), (92, (items[2][1] + " ") * 3000, 0), docs[0]]
    ddf = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    idf = spark.createDataFrame(items, "item_id long, passage string")
    spans = C.leaked_spans(ddf, idf, block=5)
    rows = spans.collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} == brute(docs, items)
    text = {d: t for d, t, _ in docs}
    for x in rows:
        assert len(C.WORD.findall(text[x["doc_id"]][x["char_from"] : x["char_to"]])) == x["n_words"] >= 10
    for x in C.removal_spans(spans).collect():
        assert 0 <= x["char_from"] < x["char_to"] <= len(text[x["doc_id"]])
    assert C.leaked_spans(ddf.limit(0), idf).count() == 0 and C.leaked_spans(ddf, idf.limit(0)).count() == 0
