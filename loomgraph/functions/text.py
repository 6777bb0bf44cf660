"""Tokens, phrases and BM25 as column expressions; whole-stage code, no UDF, and for a handful of query terms no postings shuffle."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters whose marks are folded.
MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
K1, B = 1.2, 0.75

# Words that carry no topic.
STOP_WORDS = set("a about all also an and any are as at be been but by can could did do does for from get had has have how i if in into is it its may me my no not of on or our should so than that the their them then there these they this to use was we were what when where which who why will with would you your".split())


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), MARKED, PLAIN)


def tokens(c: Column) -> Column:
    return F.filter(F.split(folded(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def laid_out(c: Column) -> Column:
    """Each token between blanks of its own, so that phrases can be counted as substrings."""
    return F.concat(F.lit(" "), F.array_join(tokens(c), "  "), F.lit(" "))


def query_phrases(query: str) -> list[list[str]]:
    """One phrase for each word between blanks; punctuation inside a word makes it a phrase of several tokens."""
    out = []
    for word in query.split():
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(ch))
        if parts := [p for p in re.split(r"[\W_]+", plain) if p]:
            out.append(parts)
    return out


def topic_terms(question: str, most: int = 6, longer_than: int = 3) -> list[str]:
    """The words of a question worth searching for."""
    seen = dict.fromkeys(p for phrase in query_phrases(question) for p in phrase if p not in STOP_WORDS and len(p) > longer_than)
    return list(seen)[:most]


def frequency(laid: Column, phrase: list[str]) -> Column:
    p = "".join(f" {t} " for t in phrase)
    return (F.length(laid) - F.length(F.replace(laid, F.lit(p), F.lit("")))) / len(p)


def bm25(df: DataFrame, id: str, text: Column, phrases: list[list[str]], any_term: bool = False) -> DataFrame:
    """(id, rank): smaller is better, as the rank of an embedded index; all phrases must occur (one, with any_term).

    Two scans of (id, text): collection statistics come back as one row. With no phrase nothing is found.
    """
    base = df.select(F.col(id).alias("id"), laid_out(F.coalesce(text, F.lit(""))).alias("laid"), F.size(tokens(F.coalesce(text, F.lit("")))).alias("len"))
    tf = [frequency(F.col("laid"), p).alias(f"tf{i}") for i, p in enumerate(phrases)]
    rows = base.select("id", "len", *tf)
    if not phrases:
        return rows.select("id", F.lit(0.0).alias("rank")).limit(0)
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
    hit = [F.col(f"tf{i}") > 0 for i in range(len(phrases))]
    wanted = hit[0]
    for h in hit[1:]:
        wanted = (wanted | h) if any_term else (wanted & h)
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
        t = F.col(f"tf{i}")
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.filter(wanted).crossJoin(F.broadcast(stats)).select("id", F.round(-score, 6).alias("rank"))


def postings(df: DataFrame, id: str, text: Column) -> DataFrame:
    """(term, id, tf, positions): the inverted index as a table, for corpora that are searched many times."""
    rows = df.select(F.col(id).alias("id"), F.posexplode(tokens(text)).alias("pos", "term"))
    return rows.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def snippet(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def estimated_tokens(c: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")
