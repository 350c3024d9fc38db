"""Ranked lexical search over documents in the order of a recursive graph bisection, by clusters with exact stopping.

A document's terms and counts become a forward table once; the number of documents, their terms and each query term's
document count are counted over all of it. Documents are then put in an order in which like ones are near each other:
the bipartite graph of documents and terms is halved again and again, swapping documents between halves while that
lowers the cost of the terms' gaps. The upper halvings are fitted on SAMPLE documents and every document is sent down
them by its terms; the lower ones are made for each shard of SHARD documents, within the task that holds it. A shard
is one row of the index: documents in order, and for each term its postings with their impacts and the largest one.

A query's bound in a shard, and in a cluster of CLUSTER neighbours there, is the sum of its terms' weights by their largest
impacts. First the shards with the best bounds of each query are searched, which gives each query a floor; then all
shards whose bound reaches it are, clusters by falling bound until the next can't reach the worst score among the best
so far. What is left out can't be in the result, not even by a tie, since a bound equal to the floor is still visited.

Queries are read in passes of PASS_TEXT characters of text at most, each of which reads the forward table and the
index once; their terms go to all tasks. So documents never move for a query, and queries never meet documents by a join.

Odd rows. A null text, or one without a term, counts for nothing and is never found. Rows with one key are documents of
their own, and so are equal rows. A null key is smaller than all others in ties. Queries without terms have no rows;
equal query rows are one query, and different texts under one key are ranked apart. Empty tables give no rows. Keys of
documents are whole numbers. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch

#: Documents of a shard and of a cluster in it; postings from which on a shard is full, whatever its documents.
SHARD, CLUSTER, POSTINGS = 1024, 64, 1_000_000
#: Documents on which the upper halvings are fitted, how many there are, and how many of the most frequent terms they look at.
SAMPLE, HALVINGS, ROUTING_TERMS = 4096, 5, 8192
#: Rounds of swaps of one halving.
ROUNDS = 8
#: Characters of queries in a pass.
PASS_TEXT = 50_000_000
#: Shards a query is searched in first.
PILOTS = 2
#: Characters of documents whose terms are counted at a time.
PASS = 4_000_000
#: Bytes that are part of a term, A-Z lower-cased; every byte of a character beyond ASCII is.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, in UTF-8."""
    return text.translate(TABLE).split()


# -- recursive graph bisection ----------------------------------------------------------------------------------


def gap_cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of the gaps of a term with that many postings among size documents, about."""
    return degree * np.log2(np.maximum(size, 1) / (degree + 1.0))


@dataclass
class Routes:
    """For each level and node, what each of the terms (ascending) speaks for the left half, and from what sum on a document goes there."""

    terms: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    def leaf_of(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Where each of n documents comes to going down the halvings."""
        node = np.zeros(n, np.int64)
        if not len(self.terms):
            return node
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        doc, at = doc[known], at[known]
        for speaks, least in self.levels:
            node = 2 * node + (np.bincount(doc, speaks[node[doc], at], minlength=n) < least[node])
        return node


def bisect(doc: np.ndarray, term: np.ndarray, n: int, n_terms: int, smallest: int = CLUSTER, levels: int | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The order of n documents by their postings (doc, term): nodes down to `smallest` documents are halved. With levels,
    so many only, and what Routes needs of each."""
    order, routes = np.arange(n), []
    for level in range(levels or 64):
        nodes = 1 << level
        if n < 2 or n / nodes <= smallest:
            break
        bounds = (np.arange(2 * nodes + 1) * n) // (2 * nodes)
        size = np.diff(bounds)
        child = np.repeat(np.arange(2 * nodes), size)  # of each place in the order
        first = bounds[:-1][child]
        # a place's partner in the other half has the same rank there
        other = bounds[:-1][child ^ 1] + (np.arange(n) - first)
        pairs = np.flatnonzero((child % 2 == 0) & (np.arange(n) - first < size[child ^ 1]))
        for _ in range(ROUNDS):
            at = np.empty(n, np.int64)
            at[order] = child
            side = at[doc]
            degree = np.bincount(side * n_terms + term, minlength=2 * nodes * n_terms).reshape(nodes, 2, n_terms).astype(float)
            sizes = size.reshape(nodes, 2, 1)
            now = gap_cost(degree, sizes)
            less, more = now - gap_cost(np.maximum(degree - 1, 0), sizes), gap_cost(degree + 1, sizes) - now
            moved = (less - more[:, ::-1]).reshape(2 * nodes * n_terms)  # gain of each posting that changes sides
            gain = np.bincount(doc, moved[side * n_terms + term], minlength=n)
            order = order[np.lexsort((-gain[order], child))]
            swap = pairs[gain[order[pairs]] + gain[order[other[pairs]]] > 1e-9]
            if not len(swap):
                break
            a, b = order[swap], order[other[swap]]
            order[swap], order[other[swap]] = b, a
        if levels:
            at[order] = child
            sizes, side = size.reshape(nodes, 2, 1), at[doc]
            degree = np.bincount(side * n_terms + term, minlength=2 * nodes * n_terms).reshape(nodes, 2, n_terms).astype(float)
            more = gap_cost(degree + 1, sizes) - gap_cost(degree, sizes)
            speaks = (more[:, 1] - more[:, 0]).astype(np.float32)
            node = at >> 1
            score = np.bincount(doc, speaks[node[doc], term], minlength=n)
            routes.append((speaks, np.array([np.median(score[node == k]) for k in range(nodes)])))
    return order, routes


# -- the forward table ------------------------------------------------------------------------------------------


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the number of them in each row."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


FORWARD = "terms array<int>, tfs array<int>, n bigint"


def forward(docs: DataFrame, key: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """doc, terms, tfs (of the numbered terms, ascending), n (all terms with repeats); documents without a term are left out."""
    schema = T.StructType([T.StructField("doc", T.LongType()), *T.StructType.fromDDL(FORWARD).fields])
    arrow, known = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = known.value.get, max(len(known.value), 1)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            start, held = 0, 0
            for i in range(len(texts)):
                held += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
                if held < PASS and i + 1 < len(texts):
                    continue
                counts, ids = [], []
                for t in texts.slice(start, i + 1 - start).to_pylist():
                    found = terms(t) if t else []
                    counts.append(len(found))
                    ids.append(np.array([x for x in map(get, found) if x is not None], np.int64))
                n = np.array(counts, np.int64)
                doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
                pair, tf = np.unique(doc * size + np.concatenate(ids), return_counts=True)
                some = np.flatnonzero(n)
                per = np.bincount(pair // size, minlength=len(ids))[some]
                keys = batch.column(0).slice(start, i + 1 - start).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([keys, lists(pair % size, per, pa.int32()), lists(tf, per, pa.int32()), pa.array(n[some])], schema=arrow)
                start, held = i + 1, 0

    return docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


# -- the index --------------------------------------------------------------------------------------------------

INDEX = "shard bigint, docs array<bigint>, terms array<int>, most array<int>, sizes array<int>, places array<int>, impacts array<int>"


def length_part(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's m: 50 for its own length against the mean one, on top of 50. In whole numbers of any size."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // total for x in n], np.int64)
    return 50 + (50 * n * documents) // total


def shard_row(number: int, keys: pa.Array, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """One shard: its documents put in order, postings by term and place."""
    local, t = np.unique(term, return_inverse=True)
    order, _ = bisect(doc, t, len(keys), max(len(local), 1))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    by = np.lexsort((place[doc], t))
    sizes = np.bincount(t, minlength=len(local))
    most = np.maximum.reduceat(impact[by], np.cumsum(sizes) - sizes) if len(by) else np.zeros(0, np.int64)
    one = lambda v, kind: lists(v, np.array([len(v)]), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.take(pa.array(order))), one(local, pa.int32()), one(most, pa.int32()),
         one(sizes, pa.int32()), one(place[doc][by], pa.int32()), one(impact[by], pa.int32())], schema=schema,
    )


def index(rows: DataFrame, halvings: Routes, documents: int, total: int) -> DataFrame:
    """Shards of a forward table. Documents are dealt by range of (leaf, hash), so a leaf of any size fills as many tasks as it needs."""
    spark = rows.sparkSession
    routes = spark.sparkContext.broadcast(halvings)
    routed = T.StructType([T.StructField("leaf", T.LongType()), *rows.schema.fields])
    arrow_routed, schema = to_arrow_schema(routed), T.StructType.fromDDL(INDEX)
    arrow = to_arrow_schema(schema)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, sizes = flat(batch, "terms")
            leaf = routes.value.leaf_of(np.repeat(np.arange(len(sizes)), sizes), term, len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], schema=arrow_routed)

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, docs, postings = TaskContext.get().partitionId() << 32, [], 0, 0

        def built() -> pa.RecordBatch:
            term, tf, sizes, n = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            tf = tf.astype(np.int64)
            impact = (10**9 * tf) // (1000 * tf + 20 * length_part(n, documents, total)[doc])
            return shard_row(number, pa.concat_arrays([h[0] for h in held]), doc, term, impact, arrow)

        for batch in batches:
            (term, sizes), (tf, _) = flat(batch, "terms"), flat(batch, "tfs")
            n, keys, ends = batch.column(3).to_numpy(), batch.column(0), np.concatenate([[0], np.cumsum(sizes)])
            a = 0
            while a < len(sizes):  # as many rows as the shard still takes, one at least
                b = min(len(sizes), a + SHARD - docs, max(a + 1, int(np.searchsorted(ends, ends[a] + POSTINGS - postings, "right")) - 1))
                held.append((keys.slice(a, b - a), term[ends[a] : ends[b]], tf[ends[a] : ends[b]], sizes[a:b], n[a:b]))
                docs, postings, a = docs + b - a, postings + int(ends[b] - ends[a]), b
                if docs >= SHARD or postings >= POSTINGS:
                    yield built()
                    number, held, docs, postings = number + 1, [], 0, 0
        if docs:
            yield built()

    mix = F.xxhash64("doc", "n", F.size("terms"))
    dealt = rows.mapInArrow(route, routed).repartitionByRange("leaf", mix).sortWithinPartitions("leaf", mix).drop("leaf")
    return dealt.select("doc", "terms", "tfs", "n").mapInArrow(shards, schema)


# -- search -----------------------------------------------------------------------------------------------------


@dataclass
class Queries:
    """Queries by number: their terms' numbers and weights one after the other, and how many terms each has."""

    term: np.ndarray
    weight: np.ndarray
    size: np.ndarray

    def __post_init__(self) -> None:
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.query = np.repeat(np.arange(len(self.size)), self.size)

    def bounds(self, known: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bound of each query, which of its terms are in the shard, at which place of the shard's terms)."""
        at = np.minimum(np.searchsorted(known, self.term), max(len(known) - 1, 0))
        there = known[at] == self.term if len(known) else np.zeros(len(self.term), bool)
        value = np.where(there, most[at] if len(most) else 0, 0) * self.weight
        sums = np.concatenate([[0], np.cumsum(value)])
        return sums[self.ends] - sums[self.starts], there, at


class Best:
    """The best `most` (score, key) of each query so far; ties to the smaller key, a null one first."""

    def __init__(self, queries: int, most: int, floor: np.ndarray) -> None:
        self.most, self.floor = most, floor.copy()
        self.score = [np.zeros(0, np.int64)] * queries
        self.key = [np.zeros(0, np.int64)] * queries
        self.null = [np.zeros(0, bool)] * queries

    def add(self, q: int, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        score, key, null = (np.concatenate(x) for x in ((self.score[q], score), (self.key[q], key), (self.null[q], null)))
        if len(score) > self.most:
            best = np.lexsort((key, ~null, -score))[: self.most]
            score, key, null = score[best], key[best], null[best]
        if len(score) == self.most:
            self.floor[q] = max(self.floor[q], score.min())
        self.score[q], self.key[q], self.null[q] = score, key, null


def search_shard(shard: dict[str, Any], queries: Queries, best: Best) -> None:
    """Adds to each query's best what the shard's clusters have, by falling bound, until none can reach the floor."""
    known, most, sizes, place, impact = (shard[k] for k in ("terms", "most", "sizes", "places", "impacts"))
    bound, there, at = queries.bounds(known, most)
    asked = np.flatnonzero((bound > 0) & (bound >= best.floor))
    if not len(asked):
        return
    clusters = -(-len(shard["keys"]) // CLUSTER)
    ends = np.cumsum(sizes)
    term_of = np.repeat(np.arange(len(sizes)), sizes)
    ceiling = np.zeros((len(sizes), clusters), np.int64)
    np.maximum.at(ceiling, (term_of, place // CLUSTER), impact)
    for q in asked:
        mine = slice(queries.starts[q], queries.ends[q])
        rows, weight = at[mine][there[mine]], queries.weight[mine][there[mine]]
        reach = weight @ ceiling[rows]
        visits = np.argsort(-reach, kind="stable")
        n = sizes[rows]
        flat_at = np.repeat(ends[rows] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where, worth = place[flat_at], np.repeat(weight, n) * impact[flat_at]
        done, step = 0, 1
        while done < clusters:
            take = visits[done : done + step]
            take = take[(reach[take] >= best.floor[q]) & (reach[take] > 0)]
            if not len(take):
                break  # bounds only fall from here on
            asked_for = np.zeros(clusters, bool)
            asked_for[take] = True
            inside = asked_for[where // CLUSTER]
            score = np.bincount(where[inside], worth[inside], minlength=len(shard["keys"])).astype(np.int64)  # whole numbers below 2^53
            found = np.flatnonzero((score > 0) & (score >= best.floor[q]))
            best.add(q, score[found], shard["keys"][found], shard["null"][found])
            done, step = done + step, 2 * step


def read_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            keys = row.column(row.schema.get_field_index("docs")).flatten()
            out: dict[str, Any] = {k: flat(row, k)[0].astype(np.int64) for k in ("terms", "most", "sizes", "places", "impacts")}
            yield out | {"keys": keys.fill_null(0).to_numpy(zero_copy_only=False), "null": keys.is_null().to_numpy(zero_copy_only=False)}


def top(shards: DataFrame, queries: Queries, floor: np.ndarray, most: int) -> DataFrame:
    """query, doc, score: at most `most` rows a query and task, among them all of the whole result that its shards hold."""
    schema = T.StructType.fromDDL("query int, doc bigint, score bigint")
    arrow, asked = to_arrow_schema(schema), shards.sparkSession.sparkContext.broadcast((queries, floor))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = asked.value
        best = Best(len(own.size), most, least)
        for shard in read_shards(batches):
            search_shard(shard, own, best)
        for q, score in enumerate(best.score):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q), pa.int32()), pa.array(best.key[q], mask=best.null[q]), pa.array(score)], schema=arrow)

    return shards.mapInArrow(run, schema)


def ranked(found: DataFrame, most: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def pilot_shards(shards: DataFrame, queries: Queries) -> DataFrame:
    """The PILOTS shards of the best bounds of each query; only the index's terms and largest impacts are read."""
    schema = T.StructType.fromDDL("query int, shard bigint, bound bigint")
    arrow, asked = to_arrow_schema(schema), shards.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = asked.value
        bound, shard = np.zeros((len(own.size), PILOTS), np.int64), np.zeros((len(own.size), PILOTS), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                new = own.bounds(flat(row, "terms")[0], flat(row, "most")[0].astype(np.int64))[0]
                worst = bound.argmin(1)
                better = np.flatnonzero(new > bound[np.arange(len(new)), worst])
                bound[better, worst[better]], shard[better, worst[better]] = new[better], row.column(0)[0].as_py()
        query = np.repeat(np.arange(len(own.size)), PILOTS)
        some = bound.ravel() > 0
        yield pa.RecordBatch.from_arrays([pa.array(query[some], pa.int32()), pa.array(shard.ravel()[some]), pa.array(bound.ravel()[some])], schema=arrow)

    best = Window.partitionBy("query").orderBy(F.col("bound").desc(), "shard")
    found = shards.select("shard", "terms", "most").mapInArrow(run, schema)
    return found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= PILOTS).select("shard").distinct()


def one_pass(work: Scratch, docs: DataFrame, texts: list[str], key: str, text: str, most: int) -> DataFrame | None:
    """query (number of the text), doc, score, rank for a pass of queries."""
    own = [sorted(set(terms(t.encode()))) for t in texts]
    number: dict[bytes, int] = {}
    for ts in own:
        for t in ts:
            number.setdefault(t, len(number))
    if not number:
        return None
    rows = work.kept(forward(docs, key, text, number), "forward")
    documents, total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    df = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # query terms alone
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = [[i for t in ts if (i := number[t]) in weight] for ts in own]
    flat_terms = np.array([i for ts in asked for i in ts], np.int64)
    queries = Queries(flat_terms, np.array([weight[i] for i in flat_terms.tolist()], np.int64), np.array([len(ts) for ts in asked], np.int64))

    shards = work.kept(index(rows, fitted(rows, df, documents), documents, total), "index")
    pilots = shards.join(F.broadcast(pilot_shards(shards, queries)), "shard", "left_semi")  # PILOTS rows a query at most
    floor = np.zeros(len(texts), np.int64)
    for q, score in ranked(top(pilots, queries, floor, most), most).where(F.col("rank") == most).select("query", "score").collect():
        floor[q] = score
    return ranked(top(shards, queries, floor, most), most)


def fitted(rows: DataFrame, df: dict[int, int], documents: int) -> Routes:
    """The upper halvings, from SAMPLE documents drawn by hash and the ROUTING_TERMS most frequent terms."""
    hashed = F.xxhash64("n", "doc")
    likely = rows.where(F.pmod(hashed, F.lit(documents)) < 2 * SAMPLE)  # about twice as many, so few that are not drawn come to the driver
    drawn = likely.orderBy(hashed, "doc").limit(SAMPLE).select("terms").collect()
    terms = np.sort(np.array(sorted(df, key=lambda t: (-df[t], t))[:ROUTING_TERMS], np.int64))
    own = [np.searchsorted(terms, t[np.isin(t, terms)]) for t in (np.array(r.terms, np.int64) for r in drawn)]
    doc = np.repeat(np.arange(len(own)), [len(t) for t in own])
    _, levels = bisect(doc, np.concatenate(own), len(own), max(len(terms), 1), levels=HALVINGS)
    return Routes(terms, levels)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = 50) -> DataFrame:
    """item, rank (from 1), doc, score: the `most` documents with the highest scores above 0 for each item, ties to the smaller key."""
    spark = docs.sparkSession
    asked = items.select(F.col(item).alias("item"), F.col(item_text).alias("asked")).where(F.col("asked").isNotNull()).distinct()
    total = asked.agg(F.sum(F.length("asked"))).first()[0] or 0
    passes = -(-total // PASS_TEXT)
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", asked.schema["item"].dataType)])
    results = Scratch(spark, "ranked-results")
    out = None
    for p in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item", "asked"), F.lit(passes)) == p).orderBy("item", "asked").collect()  # PASS_TEXT characters, about
        work = Scratch(spark, "ranked-search")
        found = one_pass(work, docs, [r.asked for r in mine], key, text, most)
        if found is not None:
            names = F.broadcast(spark.createDataFrame([(k, r.item) for k, r in enumerate(mine)], schema))  # the queries of this pass
            one = results.kept(found.join(names, "query").select("item", "rank", "doc", "score"), "results")
            out = one if out is None else out.unionByName(one)
        work.clear()
    if out is None:
        out = spark.createDataFrame([], T.StructType([schema["item"], *T.StructType.fromDDL("rank int, doc bigint, score bigint").fields]))
    return out
