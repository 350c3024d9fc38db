"""MinHash near-duplicates by chosen-path similarity joins.

Documents with equal shingle sets are one set from here on. A set is embedded as COORDINATES minwise tokens.
In each of TREES independent trees a set's path starts with the tokens of two coordinates of that tree; a node
of more than NODE sets branches: the node's own hash picks coordinates that its path has not used (FIRST of them at
first, then GROWTH / similarity on average), and its sets go on to the children that their tokens there name. So sets
stay together with the chance that a minwise token agrees, which is their similarity, and unlike ones part quickly. A small node is compared
exhaustively by its minwise tokens; its sets that seem alike form candidate clusters, sent on as a spanning
forest. The whole texts of a candidate cluster then meet once, and links are confirmed on full shingle sets;
pairs that are already connected need no further comparison, since components are what is asked for.

A candidate cluster of more than CLUSTER sets or WHOLE shingles doesn't meet in one task: hubs of it meet all its
sets first; then the sets that are still apart from its largest component meet every set with which they share one
of the shingles of their prefixes, rarest first, without which no two sets are similar enough (see large_clusters).

A large node of which half the sets agree with a pivot on as many tokens as a candidate needs is dense: these sets are
linked to the pivot, the others meet them exactly and go on (see dense). Nodes still large at DEPTH are compared
whole, part by part.

No group is taken whole by one task for being large. Joins on keys that may be hot (nodes, clusters, sets, labels) read
written tables on both sides and are written as they come, so Spark splits their skewed partitions; links go from the
smallest id of what is connected to each other one, so no id has many smaller neighbours. Intermediate tables lie in
the shared folder and are removed when they are read; the table of the result itself stays there.

A tree keeps a pair of similarity s with chance s * s in its first two steps. In a large node a pair at the threshold
has GROWTH children in common on average at each branching, so the chance that it stays together doesn't go to 0 with
depth: by the limit of that branching process 0.91 at s = 0.85 and 0.85 at 0.8, so that TREES = 12 trees miss about 3 in a
million and 1 in 12,000 pairs in the deepest nodes, 1 in five million and in 200,000 elsewhere. The estimate from 128
tokens misses one in three million at a cut five deviations below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, kept, sliced

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 128
TREES = 12
NODE = 1024
DEPTH = 24
#: Coordinates that a node branches on: at its tree's first branching, and 1 / SIMILARITY times this much on average later.
FIRST, GROWTH = 4, 1.12
CLUSTER, WHOLE = 512, 2_000_000
#: Of a larger cluster: sets sampled for its commonest tokens, sets that all others meet first, shingles that meet at once.
SAMPLE, HUBS, MEET = 64, 16, 32_000
#: Counters by which shingles of large clusters are ordered, rarest first; two that share one only cost comparisons.
COUNTERS = 1 << 20
#: The estimate's cut below the threshold, in standard deviations.
DEVIATIONS = 5.0
SEED = 7
_rng = np.random.default_rng(SEED)
_a = (_rng.integers(1, 1 << 32, COORDINATES, dtype=np.uint64) | 1).astype(np.uint32)
_b = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)
_powers = np.array([0x9E3779B97F4A7C15 ** (k + 1) % 2**64 | 1 for k in range(WORDS)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Hash of a lower-cased word; holds at most a bounded number."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; of the whole sequence, where there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(words))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _powers[k]
    return np.unique(mix(out))


def tokens(own: np.ndarray) -> np.ndarray:
    """Minwise tokens (16 bits) of a set that isn't empty."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    low = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(low, (x[a : a + 1024, None] * _a + _b).min(axis=0), out=low)
    return (mix(low.astype(np.uint64) + np.uint64(1)) >> np.uint64(48)).astype(np.uint16)


def first_nodes(sig: np.ndarray, trees: int) -> list[int]:
    t = sig[: 2 * trees].astype(np.uint64).reshape(trees, 2)
    return mix((np.arange(trees, dtype=np.uint64) << np.uint64(32)) | (t[:, 0] << np.uint64(16)) | t[:, 1]).view(np.int64).tolist()


def embed(df: DataFrame, key: str, text: str, trees: int = TREES) -> DataFrame:
    """id, n (shingles), set (two words of a 128-bit hash of the shingle set), sig, nodes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "t"):
            n, high, low, sig, nodes = [], [], [], [], []
            for t in texts:
                own = shingles(t)
                n.append(len(own))
                if not len(own):
                    for x in (high, low, sig, nodes):
                        x.append(None)
                    continue
                d = xxhash.xxh128_intdigest(own.tobytes())
                high.append((d >> 64) - (1 << 63))
                low.append((d & (2**64 - 1)) - (1 << 63))
                s = tokens(own)
                sig.append(s.tobytes())
                nodes.append(first_nodes(s, trees))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sig, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=["id", "n", "high", "low", "sig", "nodes"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "id bigint, n bigint, high bigint, low bigint, sig binary, nodes array<bigint>")


def branch(members: DataFrame, similarity: float, depth: int) -> DataFrame:
    """The children of nodes, from (node, id, sig, path); path: the coordinates that the node's path has used, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of_row = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)
            path = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(len(sig), -1)
            node, at, own = np.unique(of_row, return_index=True, return_inverse=True)
            h = mix(node + np.uint64(depth) * np.uint64(0x9E3779B97F4A7C15))
            # the node's own order of the coordinates that its path has not used
            order = mix(h[:, None] ^ mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))[None, :]) >> np.uint64(1)
            np.put_along_axis(order, path[at].astype(np.int64), np.uint64(2**64 - 1), axis=1)
            order = order.argsort(axis=1, kind="stable")
            rate = FIRST if depth == 0 else GROWTH / similarity
            count = np.minimum(int(rate) + ((h >> np.uint64(40)).astype(np.float64) / 2**24 < rate % 1), COORDINATES - path.shape[1])
            out_rows, out_nodes, out_path = [], [], []
            for k in range(int(count.max())):
                some = np.flatnonzero(count[own] > k)
                coordinate = order[own[some], k]
                token = sig[some, coordinate].astype(np.uint64)
                out_rows.append(some)
                out_nodes.append(mix(of_row[some] ^ mix((token << np.uint64(16)) + (coordinate.astype(np.uint64) << np.uint64(8)) + np.uint64(depth + 1))))
                out_path.append(np.concatenate([path[some], coordinate[:, None].astype(np.uint8)], axis=1))
            rows = np.concatenate(out_rows)
            for i in range(0, len(rows), 8192):
                taken = pa.array(rows[i : i + 8192])
                paths = np.concatenate(out_path)[i : i + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_nodes)[i : i + 8192].view(np.int64)), *(batch.column(k).take(taken) for k in (1, 2)), pa.array([x.tobytes() for x in paths], pa.binary())], names=["node", "id", "sig", "path"])

    return members.select("node", "id", "sig", "path").mapInArrow(run, "node bigint, id bigint, sig binary, path binary")


def agreement(df: DataFrame, with_: str) -> DataFrame:
    """df with agree, the number of tokens that sig and the column with_ have in common, in place of with_."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != with_) + ", agree int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            x, y = (np.frombuffer(b"".join(batch.column(names.index(k)).to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES) for k in ("sig", with_))
            rest = [k for k in names if k != with_]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(k)) for k in rest), pa.array((x == y).sum(axis=1).astype(np.int32))], names=[*rest, "agree"])

    return df.mapInArrow(run, schema)


class Forest:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows that follow each other with equal first columns: (rows, where each group starts and the end). Holds one open group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        if not rows.num_rows:
            continue
        key = np.stack([rows.column(k).to_numpy() for k in range(keys)])
        starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
        last = int(starts[-1])
        if last:
            yield rows.slice(0, last).to_batches(max_chunksize=last)[0], starts
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows.to_batches(max_chunksize=rows.num_rows)[0], np.array([0, rows.num_rows])


def pairs_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def stars(ids: np.ndarray, forest: Forest) -> tuple[list[int], list[int]]:
    """(a, b) of a forest over ascending ids: each other id with the smallest one of its tree."""
    up = [forest.find(i) for i in range(len(ids))]
    far = [i for i, k in enumerate(up) if k != i]
    return ids[[up[i] for i in far]].tolist(), ids[far].tolist()


def seeming_links(leaf: DataFrame, least: int) -> DataFrame:
    """(a, b): what is connected by agreement on `least` tokens or more in a node, as stars. Nodes of two sets, most of them, are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in runs(batches, 1):
            ids = rows.column(1).to_numpy()
            sig = np.frombuffer(b"".join(rows.column(2).to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= least]
            a, b = ids[two].tolist(), ids[two + 1].tolist()
            for start, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own, forest, apart = sig[start : start + n], Forest(n), n
                for i in range(n - 1):
                    if apart == 1:
                        break
                    for j in (np.flatnonzero((own[i + 1 :] == own[i]).sum(axis=1) >= least) + i + 1).tolist():
                        apart -= forest.join(i, j)
                x, y = stars(ids[start : start + n], forest)
                a += x
                b += y
            yield pairs_batch(a, b)

    return leaf.repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a bigint, b bigint").where("a < b").distinct()


def unite(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], hundred: int, forest: Forest, apart: int) -> None:
    """Joins the forest's trees, of which `apart` are left, by the links between shingle sets (place, set) of left and right."""
    if not left or not right:
        return
    sizes = np.array([len(x) for _, x in right])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, flat = np.unique(np.concatenate([x for _, x in right]), return_inverse=True)
    mask = np.zeros(len(values), dtype=np.int32)
    for i, x in left:
        if apart == 1:
            break
        places = np.searchsorted(values, x)
        places = places[places < len(values)]
        places = places[np.isin(values[places], x, assume_unique=True)]
        mask[places] = 1
        both = np.add.reduceat(mask[flat], offsets)
        mask[places] = 0
        for k in np.flatnonzero((both > 0) & (100 * both >= hundred * (sizes + len(x) - both))).tolist():
            apart -= forest.join(i, right[k][0])


def confirmed_links(met: DataFrame, hundred: int) -> DataFrame:
    """(a, b): what is linked among the texts that meet (meet, id, t), as stars, on full shingle sets: 100 * |A & B| >= hundred * |A | B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in runs(batches, 1):
            ids, texts = rows.column(1).to_numpy(), rows.column(2)
            a, b = [], []
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = [(i, shingles(texts[start + i].as_py() or "")) for i in range(end - start)]
                own = [(i, x) for i, x in own if len(x)]
                forest = Forest(end - start)
                unite(own, own, hundred, forest, len(own))
                x, y = stars(ids[start:end], forest)
                a += x
                b += y
            yield pairs_batch(a, b)

    return met.select("meet", "id", "t").repartition("meet").sortWithinPartitions("meet", "id").mapInArrow(run, "a bigint, b bigint").where("a < b").distinct()


#: More rounds than components can need: each about halves the longest way to a smallest id.
ROUNDS = 64


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(id, c): the smallest id reachable from each end of the edges (a, b), a < b; a table of work.

    In each round all smaller neighbours of an id are tied to the smallest of them, its parent; then every tie goes on to
    its smaller end's own parent. So ways get about half as long, and after some log2 of the longest of them each id
    is tied to the smallest of its component alone. An id's neighbours are read in sorted order, never gathered.
    """
    now, order = edges.select("a", "b"), Window.partitionBy("b").orderBy("a")
    for _ in range(ROUNDS):
        once = now.select("a", "b").distinct()  # a tie that many ids give is cut down before it is sent
        sorted_ = once.select("a", "b", F.first("a").over(order).alias("m"), F.lag("a").over(order).alias("before"))
        parent = F.col("before").isNull()
        tied = work.kept(sorted_.select("m", F.when(parent, F.col("b")).otherwise(F.col("a")).alias("x"), parent.alias("parent")), "tied")
        up = tied.where("parent").select(F.col("x").alias("m"), F.col("m").alias("p"))
        now = work.kept(tied.join(up, "m", "left").select(F.coalesce("p", "m").alias("a"), F.col("x").alias("b"), (~F.col("parent") | F.col("p").isNotNull()).alias("moved")), "jumped")
        if not now.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"components not found in {ROUNDS} rounds")
    up = now.select(F.col("b").alias("id"), F.col("a").alias("c"))
    return work.kept(up.unionByName(up.select(F.col("c").alias("id"), "c").distinct()), "components")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", hundred: int = int(100 * SIMILARITY), trees: int = TREES) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links, its own if there is none), kept.

    hundred: the similarity from which on sets are linked, in hundredths. One row for each row of df: repeated
    rows and equal sets are linked; rows without words are linked with nothing. A null key is not linked either
    and has a null component; of rows with the same key all have the same component if any set of theirs is
    linked. Columns other than key and text don't matter. An empty table gives an empty result.
    """
    similarity = hundred / 100
    least = max(1, int(COORDINATES * (similarity - DEVIATIONS * (similarity * (1 - similarity) / COORDINATES) ** 0.5)))
    base = Scratch(df.sparkSession, "near-duplicates")
    rows = base.kept(embed(df, key, text, trees), "sets")
    filled = rows.where("n > 0 and id is not null")
    alike = base.kept(filled.groupBy("high", "low").agg(F.min("id").alias("rep")), "alike")
    own = filled.join(alike.select("high", "low", F.col("rep").alias("id")), ["high", "low", "id"]).dropDuplicates(["id", "high", "low"])
    own = base.kept(own.select("id", "n", "sig", "nodes"), "own")
    cluster = components(candidates(base, own, similarity, least), base)
    found = components(confirmed(base, cluster, own, df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")), hundred), base)
    label = alike.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("high", "low", F.coalesce("c", "rep").alias("c"))
    label = base.kept(filled.select("id", "high", "low").join(base.kept(label, "labels"), ["high", "low"]).select("id", "c"), "labels")
    label = label.groupBy("id").agg(F.min("c").alias("component_id"))
    known = rows.where("id is not null").select("id", "n").join(label, "id", "left").unionByName(rows.where("id is null").select("id", "n", F.lit(None).cast("bigint").alias("component_id")))
    out = kept(known, "near-duplicates")
    base.clear()
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def candidates(base: Scratch, own: DataFrame, similarity: float, least: int) -> DataFrame:
    """(a, b): seeming links of the sets (id, sig, nodes), from all trees."""
    work = Scratch(own.sparkSession, "paths")
    signatures = own.select("id", "sig")
    used = F.unhex(F.format_string("%02x%02x", 2 * F.col("tree"), 2 * F.col("tree") + 1))
    sized = with_size(work, own.select("id", F.posexplode("nodes").alias("tree", "node")).select("node", "id", used.alias("path")), signatures, 0)
    leaves, tied, depth = [sized.where("other is null").join(signatures, "id")], [], 0
    grow = sized.where("other is not null").join(signatures, "id")
    while sized.where("other is not null").limit(1).count():
        star, around, rest = dense(work, grow, least, depth)
        tied.append(star)
        leaves.append(around)
        leaves.append(rest.where(F.col("size") <= NODE))
        rest = rest.where(F.col("size") > NODE)
        if depth == DEPTH:
            leaves.append(blocks(rest))
            break
        depth += 1
        sized = with_size(work, work.kept(branch(rest, similarity, depth - 1), "branches"), signatures, depth)
        leaves.append(sized.where("other is null"))
        grow = sized.where("other is not null")
    leaves = [x.select("node", "id", "sig") for x in leaves]
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionByName(more)
    seeming = seeming_links(leaf, least)
    for star in tied:
        seeming = seeming.unionByName(star)
    out = base.kept(seeming.distinct() if tied else seeming, "seeming")
    work.clear()
    return out


def confirmed(base: Scratch, cluster: DataFrame, own: DataFrame, texts: DataFrame, hundred: int) -> DataFrame:
    """(a, b): links that connect what all links within the candidate clusters (id, c) connect. The texts are dealt once; what follows reads those in clusters."""
    work = Scratch(own.sparkSession, "clusters")
    member = work.kept(cluster.join(own.select("id", "n"), "id"), "members")
    size = work.kept(member.groupBy("c").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")), "sizes")
    large = (F.col("sets") > CLUSTER) | (F.col("shingles") > WHOLE)
    sized = work.kept(member.join(size.select("c", large.alias("large")), "c"), "sized")
    held = work.kept(sized.hint("merge").join(texts, "id"), "texts")  # not by broadcast: clusters grow with the input
    links = base.kept(confirmed_links(held.where("not large").select(F.col("c").alias("meet"), "id", "t"), hundred), "links")
    if size.where(large).limit(1).count():
        many = work.kept(sized.where("large").drop("large").join(own.select("id", "sig"), "id"), "many")
        links = links.unionByName(base.kept(large_clusters(work, many, held.where("large").select("id", "t"), hundred), "links"))
    work.clear()
    return links


def with_size(work: Scratch, members: DataFrame, signatures: DataFrame, depth: int) -> DataFrame:
    """members with their node's number of sets, without nodes of one set; in large nodes with `other`, their pivot's signature too.

    The pivot is drawn by hash, the same one in all trees where it can be, so that the links to it coincide.
    """
    turn = F.struct(F.xxhash64("id", F.lit(depth)).alias("h"), "id")
    n = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(turn).alias("first")).where("size > 1")
    n = n.select("node", "size", F.when(F.col("size") > NODE, F.col("first.id")).alias("pivot"))
    n = work.kept(n.join(signatures.select(F.col("id").alias("pivot"), F.col("sig").alias("other")), "pivot", "left").drop("pivot"), "node-sizes")
    return work.kept(members.join(n, "node"), "nodes")


def part(size, most: int):
    """Number of parts of about `most` that a size is dealt into."""
    return F.greatest(F.lit(1), F.ceil(size / most)).cast("bigint")


def dense(work: Scratch, grow: DataFrame, least: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For large nodes (node, id, sig, size, path, other): what their pivots tie together, leaves, and the members that go on, with their new size.

    A node is dense if half of its sets agree with its pivot on `least` tokens or more. These sets
    are one candidate cluster by their links to the pivot, so each other set needs to meet them only as far as it can
    be linked to one of them: Hamming distance is a metric, so such a set agrees with the pivot on 2 * least - COORDINATES
    or more. It meets all of them, part by part; so every seeming link of theirs in the node is found and they needn't
    go on. All sets of nodes that aren't dense do.
    """
    met = work.kept(agreement(grow.select("node", "id", "sig", "size", "path", "other"), "other"), "agreement")
    near, reach = F.col("agree") >= least, F.col("agree") >= 2 * least - COORDINATES
    count = met.groupBy("node").agg(F.count(F.when(near, 1)).alias("close"), F.count(F.when(reach & ~near, 1)).alias("around"), F.max("size").alias("all"), F.min(F.when(near, F.col("id"))).alias("first"))
    known = work.kept(met.join(work.kept(count, "counts"), "node").withColumn("dense", 2 * F.col("close") >= F.col("all")), "known")
    star = known.where(F.col("dense") & near & (F.col("id") != F.col("first"))).select(F.col("first").alias("a"), F.col("id").alias("b"))
    half = max(1, NODE // 2)
    inner, outer = part(F.col("close"), half), part(F.col("around"), half)
    own = lambda n: F.pmod(F.xxhash64("id", "node", F.lit(depth)), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    open_ = known.where(F.col("dense") & (F.col("around") > 0))
    x = open_.where(near).withColumn("i", own(inner)).withColumn("j", each(outer))
    y = open_.where(reach & ~near).withColumn("j", own(outer)).withColumn("i", each(inner))
    leaves = x.unionByName(y).select(F.xxhash64("node", F.lit(depth), "i", "j").alias("node"), "id", "sig")
    rest = known.where(~(F.col("dense") & near)).withColumn("size", F.when(F.col("dense"), F.col("all") - F.col("close")).otherwise(F.col("all")))
    return star, leaves, rest.select("node", "id", "sig", "size", "path")


def blocks(nodes: DataFrame) -> DataFrame:
    """Leaves in which all pairs of a node's sets meet: each two of its parts are one."""
    count = part(F.col("size"), max(1, NODE // 2))
    dealt = nodes.withColumn("i", F.pmod(F.xxhash64("id", "node"), count)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    return dealt.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "id", "sig")


def large_clusters(work: Scratch, many: DataFrame, texts: DataFrame, hundred: int) -> DataFrame:
    """(a, b): links that connect what all links within the candidate clusters (id, c, n, sig) connect.

    First a few hubs meet all sets of their cluster; hubs only save work: they're the sets that agree most with the
    tokens that are commonest in a sample of the cluster. What is outside the largest component of its cluster then
    meets all that it can be linked to, by the prefix filter: two sets of similarity t share a shingle among the first
    n - ceil(t * n) + 1 of each in any order common to both, and rarest first few sets share one. So no link of an
    unconnected set is left out, however large the cluster.
    """

    def commonest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in runs(batches, 1):
            sig = np.frombuffer(b"".join(rows.column(1).to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)
            out = []
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = sig[start:end]
                votes = (own[:, None] == own[None]).sum(axis=1)
                out.append(own[votes.argmax(axis=0), np.arange(COORDINATES)].tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(starts[:-1])), pa.array(out, pa.binary())], names=["c", "common"])

    def first(rows: DataFrame, by: list, most: int) -> DataFrame:  # Spark cuts each partition to `most` rows a cluster before the exchange
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(*by))).where(F.col("r") <= most).drop("r")

    sample = first(many, [F.xxhash64("id"), "id"], SAMPLE).select("c", "sig")
    common = work.kept(sample.repartition("c").sortWithinPartitions("c").mapInArrow(commonest, "c bigint, common binary"), "common")
    scored = agreement(many.join(common, "c"), "common")
    hubs = first(scored, [F.desc("agree"), "id"], HUBS).select("id", F.lit(True).alias("hub"))
    rows = many.join(hubs, "id", "left")
    rows = work.kept(rows.select(F.col("c").alias("g"), "id", "n", F.col("id").alias("label"), F.col("hub").isNotNull().alias("asks")), "hubs")
    near = work.kept(links_between(work, rows, texts, hundred), "links")
    labels = many.join(components(near, work).withColumnRenamed("c", "l"), "id", "left").select("c", "id", "n", F.coalesce("l", "id").alias("label"))
    labels = work.kept(labels, "labels")
    top = labels.groupBy("c", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("c").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    top = work.kept(top.where("labels > 1").select("c", F.col("top.label").alias("top")), "top")
    if not top.limit(1).count():
        return near
    left = labels.join(top, "c").withColumn("asks", F.col("label") != F.col("top")).drop("top")
    left = work.kept(left.hint("merge").join(texts, "id").select("c", "id", "n", "label", "asks", "t"), "apart")
    rows = work.kept(prefixes(left, hundred), "prefixes")
    return near.unionByName(links_between(work, rows, texts, hundred))


def counters(c: np.ndarray | int, own: np.ndarray) -> np.ndarray:
    return (mix(own ^ mix(np.array([c], dtype=np.int64).view(np.uint64))) >> np.uint64(40)).astype(np.int64) & (COUNTERS - 1)


def prefixes(held: DataFrame, hundred: int) -> DataFrame:
    """(g, id, n, label, asks): a row for each cluster and shingle of a set's prefix, from (c, id, n, label, asks, t)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTERS, dtype=np.int64)
        for batch, texts in sliced(batches, "t"):
            for c, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                np.add.at(out, counters(c, shingles(t)), 1)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["k", "n"])

    found = held.select("c", "t").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n")).toPandas().to_numpy(dtype=np.int64)  # COUNTERS rows at most
    table = np.zeros(COUNTERS, dtype=np.int64)
    table[found[:, 0]] = found[:, 1]
    sent = held.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "t"):
            rows, keys = [], []
            for i, (c, t) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                own = shingles(t)
                most = len(own) - -(-hundred * len(own) // 100) + 1
                own = own[np.lexsort((own, sent.value[counters(c, own)]))][:most]
                keys.append(mix(own ^ mix(np.array([c], dtype=np.int64).view(np.uint64) + np.uint64(1))).view(np.int64))
                rows.append(np.full(len(own), i))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(batch.column(k).take(at) for k in (1, 2, 3, 4))], names=["g", "id", "n", "label", "asks"])

    return held.select("c", "id", "n", "label", "asks", "t").mapInArrow(run, "g bigint, id bigint, n bigint, label bigint, asks boolean")


def links_between(work: Scratch, rows: DataFrame, texts: DataFrame, hundred: int) -> DataFrame:
    """(a, b): links of the sets that ask to all sets of the same group, from (g, id, n, label, asks); label: what is connected already. Every two parts of about MEET shingles meet."""
    parts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("sets"), part(F.sum(F.when(F.col("asks"), F.col("n"))), MEET).alias("p"), part(F.sum("n"), MEET).alias("q"), F.max("asks").alias("asked"))
    parts = work.kept(parts.where("sets > 1 and asked").select("g", "p", "q"), "groups")
    dealt = work.kept(rows.join(parts, "g"), "dealt")
    own = lambda n: F.pmod(F.xxhash64("id", "g"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    x = dealt.where("asks").withColumn("i", own("p")).withColumn("j", each("q")).withColumn("side", F.lit(0))
    y = dealt.withColumn("j", own("q")).withColumn("i", each("p")).withColumn("side", F.lit(1))
    columns = [F.xxhash64("g", "i", "j").alias("meet"), "side", "id", "label"]
    met = x.select(*columns).unionByName(y.select(*columns)).hint("merge").join(texts, "id").select("meet", "side", "id", "label", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in runs(batches, 1):
            side, ids, label, texts_ = rows.column(1).to_numpy(), rows.column(2).to_pylist(), rows.column(3).to_pylist(), rows.column(4)
            a, b = [], []
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                held = [(i, x) for i, x in ((i, shingles(texts_[start + i].as_py() or "")) for i in range(end - start)) if len(x)]
                forest, at, apart = Forest(end - start), {}, 0
                for i in range(end - start):
                    j = at.setdefault(label[start + i], i)
                    apart += j == i
                    forest.join(i, j)
                left, right = ([(i, x) for i, x in held if side[start + i] == k] for k in (0, 1))
                before = [forest.find(i) for i in range(end - start)]
                unite(left, right, hundred, forest, apart)
                smallest: dict[int, int] = {}
                for i in range(end - start):
                    k = forest.find(i)
                    smallest[k] = min(ids[start + i], smallest.get(k, ids[start + i]))
                tied = {i for i in range(end - start) if forest.find(i) != before[i]}
                tied |= {forest.find(i) for i in tied}  # one of each tree that was joined
                a += [smallest[forest.find(i)] for i in tied]
                b += [ids[start + i] for i in tied]
            yield pairs_batch(a, b)

    return met.repartition("meet").sortWithinPartitions("meet", "side", "id").mapInArrow(run, "a bigint, b bigint").where("a < b").distinct()
