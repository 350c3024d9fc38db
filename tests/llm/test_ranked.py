"""Ranked search against every document's score, and its parts against plain forms."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tracklens.llm")
from tracklens.llm import queries, ranked  # noqa: E402

DATA = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, most=50):
    """[(item, rank, doc, score)] from the scores of all documents."""
    counted = [(k, Counter(t), len(t)) for k, text in docs if (t := terms(text))]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for k, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, k is not None, k or 0))
        out += [(item, r, k if some else None, -s) for r, (s, some, k) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms_by_bytes():
    rng = random.Random(1)
    marks = [chr(c) for c in range(0x180)] + ["日", "\U0001f600", " ", " ", "Σ"]
    for _ in range(500):
        text = "".join(rng.choices(marks, k=40))
        assert [t.decode() for t in ranked.terms(text.encode())] == terms(text)


def test_query_on_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert collected(queries.op12_ranked_search(spark, DATA).select("item_id", "rank", "doc_id", "score")) == brute(docs, items)


def test_many_shards_hot_terms_ties_and_odd_rows(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)] + ["the"] * 300
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(4000)]
    docs += [(10_000 + k, "the same copy of many w1 w2 w3") for k in range(1500)]  # ties, to the smaller key
    docs += [(None, "w1 w2"), (None, None), (5, None), (5, ""), (6, "... !?"), (7, "The THE the"), (7, "The THE the"), (-3, "the same copy of many w1 w2 w3"), (20_000, "w5 " * 50_000), (20_001, "É日本 é w9")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(30)] + [(100, "w1 w2 w3 copy"), (100, "w1 w2 w3 copy"), (101, None), (102, ""), (103, "nothing-like-it"), (104, "the"), (None, "É日本 W9"), (105, "w5")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit("x")).repartition(7)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    assert collected(ranked.search(d, q)) == brute(docs, items)
    assert collected(ranked.search(d, q, most=3)) == brute(docs, items, 3)
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("text is null"), q)):
        assert ranked.search(a, b).count() == 0


def test_stopping_is_exact_and_leaves_clusters_out(monkeypatch):
    """One shard with small clusters: the best of each query are those of all documents, from less than all clusters."""
    monkeypatch.setattr(ranked, "CLUSTER", 16)
    rng = np.random.default_rng(0)
    n, n_terms = 600, 120
    doc, term = np.divmod(np.unique(rng.integers(0, n, 9000) * n_terms + np.minimum(rng.geometric(0.05, 9000), n_terms - 1)), n_terms)
    impact = rng.integers(1, 1000, len(doc))
    batch = ranked.shard_row(3, ranked.pa.array(range(n), ranked.pa.int64()), doc, term, impact, ranked.to_arrow_schema(ranked.T.StructType.fromDDL(ranked.INDEX)))
    (shard,) = ranked.read_shards([batch])
    own = [np.sort(rng.choice(n_terms, 5, replace=False)) for _ in range(40)]
    q = ranked.Queries(np.concatenate(own), rng.integers(1, 50, 200), np.full(40, 5))
    best = ranked.Best(40, 5, np.zeros(40, np.int64))
    seen = []
    add = best.add
    monkeypatch.setattr(best, "add", lambda k, s, *x: (seen.append(len(s)), add(k, s, *x)))
    ranked.search_shard(shard, q, best)
    for k in range(40):
        score = np.zeros(n, np.int64)
        for t, w in zip(own[k], q.weight[5 * k : 5 * k + 5]):
            score[doc[term == t]] += w * impact[term == t]
        wanted = sorted((-s, i) for i, s in enumerate(score) if s > 0)[:5]
        assert sorted(zip((-best.score[k]).tolist(), best.key[k].tolist())) == wanted
    assert sum(seen) < 0.8 * 40 * n


def test_bisection_lowers_the_cost_of_gaps():
    rng = np.random.default_rng(3)
    n, topics = 1024, 8
    topic = rng.permutation(n) % topics
    doc = np.repeat(np.arange(n), 20)
    term = np.where(rng.random(20 * n) < 0.8, topic[doc] * 50 + rng.integers(0, 50, 20 * n), rng.integers(0, 400, 20 * n))

    def cost(order):
        place = np.empty(n, int)
        place[order] = np.arange(n)
        total = 0.0
        for t in range(400):
            p = np.sort(place[np.unique(doc[term == t])])
            total += np.log2(np.diff(p, prepend=-1)).sum()
        return total

    order, _ = ranked.bisect(doc, term, n, 400)
    assert sorted(order.tolist()) == list(range(n))
    assert cost(order) < 0.75 * cost(np.arange(n))
    _, levels = ranked.bisect(doc, term, n, 400, levels=3)
    leaf = ranked.Routes(np.arange(400), levels).leaf_of(doc, term, n)
    # documents of one topic mostly come to one leaf, and leaves are about equally full
    same = sum(Counter(leaf[topic == t].tolist()).most_common(1)[0][1] for t in range(topics))
    assert same > 0.8 * n and max(Counter(leaf.tolist()).values()) < 2.5 * n / 8
    for few in (0, 1, 2, 65):
        order, _ = ranked.bisect(np.arange(few), np.zeros(few, int), few, 1, smallest=1)
        assert sorted(order.tolist()) == list(range(few))
