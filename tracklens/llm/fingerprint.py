"""Document fingerprints by randomised edit embedding.

A random walk over a text's characters, shared by all texts, repeats or leaves each character by coin flips
that depend on the step and the character: two texts a few edits apart fall back in step soon after each edit,
so edit distance becomes Hamming distance between the walks. A text is walked from start to end, twice as many steps
as it has characters. How long a walk that comes to a character at a step waits there is read from a table of
characters by steps: the walks of a pass advance together, one character at a time, while LANES or more are left, and
one by one after that. A
fingerprint samples the walk: SAMPLES steps of each octave of the walk's length, the same for all texts, four
bits a sample. Likeness weighs the octaves by their length and is corrected for chance agreement.

near_duplicates() finds pairs by bands of sampled positions, verifies them by likeness of the fingerprints and gives
every text the class of what is linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PASS_CHARS, Scratch, dealt_join, free, kept, passes
from .neardup import Forest, components, runs

LANES, RUN = 16, 512
#: Characters and steps of the table that a worker keeps (64 MB at most); others are computed where they are met.
COMMON, KEPT_STEPS = 256, 1 << 18
SAMPLES = 32
OCTAVES = 40
#: A symbol's code where a walk has run past its text's end.
PAST = 0x110000
SEED = 20_240_229
#: Agreement of two unrelated samples, as natural text has it; likeness 0 starts there.
CHANCE = 0.12
#: Sampled places of a band (fewer below LOOSE, where agreement is rarer), and the share of pairs at the threshold that all bands of an octave pair may miss.
BAND_BITS, FEW_BITS, LOOSE, MISS = 6, 4, 0.7, 1e-4
#: Fingerprints of a bucket that meet as pairs, and of a larger one's parts.
BUCKET, PART = 64, 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def octave_steps(o: int) -> np.ndarray:
    """Steps sampled in octave o: 0 to SAMPLES - 1 in octave 0, then SAMPLES of [SAMPLES * 2**(o-1), SAMPLES * 2**o), one in each equal part."""
    if o == 0:
        return np.arange(SAMPLES, dtype=np.int64)
    low = SAMPLES << (o - 1)
    part = low // SAMPLES
    rng = np.random.default_rng([SEED, o])
    return low + np.arange(SAMPLES) * part + rng.integers(0, part, SAMPLES)


_steps = [octave_steps(o) for o in range(OCTAVES)]


def walk_length(n_chars: int) -> int:
    return 2 * n_chars


def octaves(n_chars: int) -> int:
    """Octaves that a text's walk reaches."""
    n, o = walk_length(n_chars), 0
    while n > (SAMPLES << o):
        o += 1
    return o + 1 if n else 0


def waits(symbols: np.ndarray, low: int, high: int) -> np.ndarray:
    """Steps that a walk waits at each symbol (row) when it comes to it at each step of [low, high), 255 at most."""
    n = high - low + 255
    salt = (np.arange(low, low + n, dtype=np.uint64) * np.uint64(0x85EBCA77) + np.uint64(SEED)).astype(np.uint32)
    moves = (_mix((symbols.astype(np.uint32) * np.uint32(0x9E3779B1))[:, None] + salt[None, :]) >> np.uint32(31)).astype(bool)
    at = np.where(moves, np.arange(n, dtype=np.int32), np.int32(n))
    ahead = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, : high - low]
    return np.minimum(ahead - np.arange(high - low, dtype=np.int32), 255).astype(np.uint8)


_kept = np.zeros((COMMON, 0), dtype=np.uint8)


def table(symbols: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, row): waits at steps [low, high), and the row of each of the ascending symbols."""
    global _kept
    if high > KEPT_STEPS:
        return waits(symbols, low, high), np.arange(len(symbols))
    if high > _kept.shape[1]:
        to = min(KEPT_STEPS, max(4096, 1 << (high - 1).bit_length()))
        parts = [waits(np.arange(COMMON), a, min(a + 4096, to)) for a in range(_kept.shape[1], to, 4096)]
        _kept = np.concatenate([_kept, *parts], axis=1)
    rare = symbols[symbols >= COMMON]
    rows = _kept[:, low:high]
    if len(rare):
        rows = np.concatenate([rows, waits(rare, low, high)])
    return rows, np.where(symbols < COMMON, symbols, COMMON - (len(symbols) - len(rare)) + np.arange(len(symbols))).astype(np.int64)


def leaving(chars: np.ndarray, enter: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each walk (row) leaves each of its next characters, and the step after the last; rows in descending order of sizes."""
    out = np.full(chars.shape, np.iinfo(np.int64).max, dtype=np.int64)
    symbols, which = np.unique(chars, return_inverse=True)
    which = which.reshape(chars.shape).T
    low = int(enter.min())
    high = int(enter.max()) + 3 * chars.shape[1] + 64
    rows, row = table(symbols, low, high)
    index = np.ascontiguousarray(row[which])
    now = enter.copy()
    for k in range(chars.shape[1]):
        a = int(np.searchsorted(-sizes, -k, side="left"))  # walks with more than k characters here
        at = now[:a] - low
        if a and int(at.max()) >= high - low:  # a walk that has waited for very long: a wider table
            high = int(now[:a].max()) + 3 * (chars.shape[1] - k) + 64
            rows, row = table(symbols, low, high)
            index = np.ascontiguousarray(row[which])
        left = now[:a] + rows[index[k, :a], at]
        out[:a, k] = left
        now[:a] = left + 1
    return out, now


def leaving_alone(chars: np.ndarray, enter: int) -> tuple[np.ndarray, int]:
    """The same for one walk."""
    symbols, which = np.unique(chars, return_inverse=True)
    out: list[int] = []
    low, done, of = enter, 0, which.tolist()
    while done < len(of):
        high = low + 3 * (len(of) - done) + 64
        rows, row = table(symbols, low, high)
        wait = [rows[r].tobytes() for r in row.tolist()]
        i, most = 0, high - low
        for c in of[done:]:
            if i >= most:
                break
            i += wait[c][i]
            out.append(low + i)
            i += 1
        low, done = low + i, len(out)
    return np.array(out, dtype=np.int64), low


def fingerprints(texts: list[str]) -> list[str]:
    """Hexadecimal digits, SAMPLES for each octave; past a walk's end a sample is '-'. An empty text's is empty."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    order = np.argsort(-lens, kind="stable")  # texts that end first stand last, so the live ones are a prefix
    first, size = (np.cumsum(lens) - lens)[order], lens[order]
    # samples wanted, by walk and step: which step of which walk goes to which place of the result
    n_oct = np.array([octaves(int(n)) for n in lens], dtype=np.int64)
    out_at = np.concatenate([[0], np.cumsum(n_oct * SAMPLES)]).astype(np.int64)
    out = np.full(int(out_at[-1]), ord("-"), dtype=np.uint8)
    steps = np.concatenate(_steps[: int(n_oct.max(initial=0))] or [np.zeros(0, dtype=np.int64)])
    walk = np.repeat(np.arange(len(order)), n_oct[order] * SAMPLES)
    nth = np.arange(len(walk)) - np.repeat(np.cumsum(n_oct[order] * SAMPLES) - n_oct[order] * SAMPLES, n_oct[order] * SAMPLES)
    step, place = steps[nth], out_at[order][walk] + nth
    inside = step < 2 * size[walk]
    walk, step, place = walk[inside], step[inside], place[inside]
    digits = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
    out[place] = digits[_mix(np.array([PAST], dtype=np.uint32))[0] & np.uint32(15)]  # unless a character is found below
    enter, done = np.zeros(len(order), dtype=np.int64), 0
    while True:
        live = int(np.searchsorted(-size, -done, side="left"))
        if live < LANES:
            break
        width = int(min(RUN, size[0] - done))
        at = np.minimum(first[:live, None] + done + np.arange(width), len(points) - 1)
        chars, here = points[at], size[:live] - done
        came = enter[:live].copy()
        left, enter[:live] = leaving(chars, came, here)
        some = np.flatnonzero((walk < live) & (step >= came[np.minimum(walk, live - 1)]) & (step < enter[np.minimum(walk, live - 1)]))
        # which character a walk stands on at a step: the first that it leaves at that step or later
        span = int(enter[:live].max()) + 1
        flat = (np.minimum(left, span) + np.arange(live, dtype=np.int64)[:, None] * (span + 1)).ravel()
        k = np.searchsorted(flat, walk[some] * (span + 1) + step[some]) - walk[some] * width
        out[place[some]] = digits[_mix(chars[walk[some], k]) & np.uint32(15)]
        done += width
    for w in range(live):
        now = int(enter[w])
        own = np.flatnonzero(walk == w)
        for a in range(done, int(size[w]), 4 * RUN):
            chars = points[int(first[w]) + a : int(first[w]) + min(a + 4 * RUN, int(size[w]))]
            came = now
            left, now = leaving_alone(chars, came)
            some = own[(step[own] >= came) & (step[own] < now)]
            out[place[some]] = digits[_mix(chars[np.searchsorted(left, step[some])]) & np.uint32(15)]
    text = out.tobytes().decode()
    return [text[a:b] for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True)]


def likeness(a: str, b: str) -> float:
    """0 to 1; two empty fingerprints are alike, an empty one is like no other."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    n = max(len(a), len(b)) // SAMPLES
    x = np.frombuffer(a.ljust(n * SAMPLES, "-").encode(), dtype=np.uint8).reshape(n, SAMPLES)
    y = np.frombuffer(b.ljust(n * SAMPLES, "-").encode(), dtype=np.uint8).reshape(n, SAMPLES)
    used = ((x != 45) | (y != 45)).sum(axis=1)
    weight = used / SAMPLES * np.array([1, *(1 << o for o in range(n - 1))], dtype=np.float64)
    agree = ((x == y) & (x != 45)).sum(axis=1) / np.maximum(1, used)
    raw = float((weight * agree).sum() / weight.sum())
    return max(0.0, (raw - CHANCE) / (1 - CHANCE))


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with each whole text's fingerprint; null texts count as empty. A column of the name is replaced. Narrow."""
    from .common import appended, sliced, with_fields

    schema = with_fields(df, **{out: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch, texts in sliced(batches, text):
            made = made or pa.schema([f for f in batch.schema if f.name.lower() != out.lower()] + [pa.field(out, pa.string())])
            yield appended(batch, made, **{out: pa.array(fingerprints(texts), pa.string())})

    return df.mapInArrow(run, schema)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """likeness of each a with its b, all at once."""
    n = max((len(x) for x in (*a, *b)), default=0) // SAMPLES
    if not n:
        return np.array([1.0 if x == y else 0.0 for x, y in zip(a, b, strict=True)])
    grid = lambda xs: np.frombuffer("".join(x.ljust(n * SAMPLES, "-") for x in xs).encode(), dtype=np.uint8).reshape(len(xs), n, SAMPLES)
    x, y = grid(a), grid(b)
    used = ((x != 45) | (y != 45)).sum(axis=2)
    weight = used / SAMPLES * np.array([1, *(1 << o for o in range(n - 1))], dtype=np.float64)
    agree = ((x == y) & (x != 45)).sum(axis=2) / np.maximum(1, used)
    raw = (weight * agree).sum(axis=1) / np.maximum(1e-9, weight.sum(axis=1))
    out = np.maximum(0.0, (raw - CHANCE) / (1 - CHANCE))
    filled = np.array([bool(x) and bool(y) for x, y in zip(a, b, strict=True)])
    return np.where([x == y for x, y in zip(a, b, strict=True)], 1.0, np.where(filled, out, 0.0))


def band_places(least: float) -> list[list[int]]:
    """Places of each band within two octaves, half of them in the first."""
    bits = BAND_BITS if least >= LOOSE else FEW_BITS
    p = CHANCE + (1 - CHANCE) * min(least, 0.99)
    rng = np.random.default_rng(SEED)
    half = lambda: rng.choice(SAMPLES, bits // 2, replace=False)
    return [sorted([*half().tolist(), *(half() + SAMPLES).tolist()]) for _ in range(int(np.ceil(np.log(MISS) / np.log(1 - p**bits))))]


def verified(pairs: DataFrame, one: DataFrame, least: float) -> DataFrame:
    """pairs (a, b, and what else they have) with likeness, those of `least` or more; one: (k, fingerprint)."""
    left, right = one.select(F.col("k").alias("a"), F.col("fingerprint").alias("fa")), one.select(F.col("k").alias("b"), F.col("fingerprint").alias("fb"))
    like = F.arrow_udf(lambda x, y: pa.array(likenesses(x.to_pylist(), y.to_pylist()), pa.float64()), "double")
    return pairs.join(left, "a").join(right, "b").withColumn("likeness", like("fa", "fb")).drop("fa", "fb").where(F.col("likeness") >= least)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """key, fingerprint and class_id, the smallest key that is reached by links; one row for each row of df.

    Rows with equal fingerprints are of one class; different ones are linked from a likeness of `least` on, as links()
    finds them. Rows with a null key have a null class; null and empty texts are of one class each, their own.
    """
    base = Scratch(df.sparkSession, "fingerprints")
    prints = base.kept(add_fingerprint(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "t").select("k", "fingerprint"), "prints")
    one = base.kept(prints.where("k is not null and fingerprint <> ''").groupBy("fingerprint").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n")), "one")
    found = components(links(one.select(F.col("rep").alias("k"), "fingerprint"), least, base).select("a", "b"), base)
    label = one.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fingerprint", F.coalesce("c", "rep").alias("class_id"))
    known = dealt_join(prints.where("fingerprint <> ''"), label, ["fingerprint"], "left", one.select("fingerprint", "n"))
    rest = prints.where("fingerprint = ''").withColumn("class_id", F.col("k"))
    out = kept(known.select("k", "fingerprint", "class_id").unionByName(rest.select("k", "fingerprint", "class_id")), "fingerprint-classes")
    base.clear()
    return out.select(F.col("k").alias(key), "fingerprint", F.when(F.col("k").isNotNull(), F.col("class_id")).alias("class_id"))


def links(one: DataFrame, least: float = 0.8, keep: Scratch | None = None) -> DataFrame:
    """(a, b, likeness), a < b: banded and verified links of different fingerprints (k, fingerprint), k unique.

    A band is a set of sampled places of two neighbouring octaves and their number. A fingerprint has bands on the last
    two octaves that its walk reaches, and on the two pairs before, so near copies on both sides of an octave's
    limit have common ones; at the threshold the bands of one pair miss one link in 10,000. In a bucket of up to
    BUCKET fingerprints all pairs are verified. In a larger one all are held against a pivot, the same in all buckets
    where it can be, and those unlike it against all others, part by part; so what links connect is whole, but not every
    link between fingerprints that are connected already is listed. A crowded bucket of unlike fingerprints costs the
    square of its size.
    """
    work, keep = Scratch(one.sparkSession, "bands"), keep or Scratch(one.sparkSession, "links")
    last = (F.length("fingerprint") / SAMPLES).cast("int") - 2
    bases = one.withColumn("o", F.explode(F.array_distinct(F.array(*(F.greatest(last - i, F.lit(0)) for i in range(3))))))
    place = lambda p: F.substring(F.col("fingerprint"), F.col("o") * SAMPLES + p + 1, F.lit(1))
    bands = [F.xxhash64(F.lit(i), F.col("o"), *map(place, ps)) for i, ps in enumerate(band_places(least))]
    rows = bases.select("k", F.explode(F.array(*bands)).alias("band"))
    size = work.kept(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    rows = work.kept(dealt_join(rows, size.withColumnRenamed("n", "size"), ["band"], counts=size), "rows")
    few = rows.where(F.col("size") <= BUCKET).select("k", "band")
    pairs = few.withColumnRenamed("k", "a").join(few.withColumnRenamed("k", "b"), "band").where("a < b").select("a", "b").distinct()
    out = keep.kept(verified(pairs, one, least), "links")
    many = work.kept(rows.where(F.col("size") > BUCKET), "many")
    if many.limit(1).count():
        large = size.where(F.col("n") > BUCKET)
        pivot = many.groupBy("band").agg(F.min(F.struct(F.xxhash64("k").alias("h"), "k")).alias("p")).select("band", F.col("p.k").alias("pivot"))
        held = work.kept(dealt_join(many, pivot, ["band"], counts=large), "held")
        star = held.where("k <> pivot").select(F.least("k", "pivot").alias("a"), F.greatest("k", "pivot").alias("b")).distinct()
        star = work.kept(verified(star, one, least), "star")
        held = held.withColumns({"a": F.least("k", "pivot"), "b": F.greatest("k", "pivot")}).join(star.select("a", "b", F.lit(True).alias("linked")), ["a", "b"], "left")
        held = work.kept(held.select("band", "k", (F.col("linked").isNull() & (F.col("k") != F.col("pivot"))).alias("asks")), "asks")
        out = out.unionByName(star).unionByName(keep.kept(met_in_parts(work, held, large, one, least), "links"))
    out = keep.kept(out.dropDuplicates(["a", "b"]), "links")
    work.clear()
    return out


def met_in_parts(work: Scratch, held: DataFrame, large: DataFrame, one: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness): spanning forests of the links of the fingerprints that ask with all of their bucket (band, k, asks)."""
    part = lambda n: F.greatest(F.lit(1), F.ceil(n / PART)).cast("bigint")
    parts = held.groupBy("band").agg(part(F.sum(F.col("asks").cast("int"))).alias("p"), part(F.count(F.lit(1))).alias("q"), F.max("asks").alias("asked")).where("asked")
    dealt = work.kept(dealt_join(held, parts.select("band", "p", "q"), ["band"], counts=large), "dealt")
    own = lambda n: F.pmod(F.xxhash64("k", "band"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    x = dealt.where("asks").withColumn("i", own("p")).withColumn("j", each("q")).withColumn("side", F.lit(0))
    y = dealt.withColumn("j", own("q")).withColumn("i", each("p")).withColumn("side", F.lit(1))
    columns = [F.xxhash64("band", "i", "j").alias("meet"), "side", "k"]
    met = x.select(*columns).unionByName(y.select(*columns)).join(one, "k").select("meet", "side", "k", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in runs(batches, 1):
            side, ids, prints = rows.column(1).to_numpy(), rows.column(2).to_pylist(), rows.column(3).to_pylist()
            a, b, like = [], [], []
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                right = [i for i in range(start, end) if side[i]]
                place = {ids[i]: i - start for i in right}
                forest = Forest(end - start)
                for i in range(start, end):
                    if side[i] == 0:
                        found = likenesses([prints[i]] * len(right), [prints[j] for j in right])
                        for m in np.flatnonzero(found >= least).tolist():
                            if ids[right[m]] != ids[i] and forest.join(place.get(ids[i], i - start), right[m] - start):
                                a.append(min(ids[i], ids[right[m]]))
                                b.append(max(ids[i], ids[right[m]]))
                                like.append(float(found[m]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], names=["a", "b", "likeness"])

    return met.repartition("meet").sortWithinPartitions("meet", "side", "k").mapInArrow(run, "a bigint, b bigint, likeness double")


# -- a document, its edited text and its neighbour ------------------------------------------------------------

BUCKET_ROWS = 4000


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next row is the one before in ascending (key, text); after the first comes the last. Null texts are
    empty; null keys come first. A table of one row is its own next; an empty table gives an empty result.

    Rows are dealt to ranges of keys, and the last row of each range is sent along to the following one, so each
    range has its neighbours at hand and one exchange of the texts is all. The driver gets the ranges' bounds.
    """
    low = -(1 << 63)
    k, t, bucket, helper = free(df, "k", "t", "bucket", "helper")
    rows = df.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(t), F.coalesce(F.col(key).cast("long"), F.lit(low)).alias(k))
    keys = df.select(F.coalesce(F.col(key).cast("long"), F.lit(low)).alias(k))
    n = keys.count()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(a, b) for a, b in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())))])
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], schema)
    parts = max(1, min(100_000, n // BUCKET_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(x) for x in keys.approxQuantile(k, [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    # keys up to 2**53 keep their order as doubles; larger ones may share a bound, which moves rows, not results
    limits = spark.sparkContext.broadcast(np.array(bounds, dtype=np.int64))  # fewer than parts
    number = F.arrow_udf(lambda x: pa.array(np.searchsorted(limits.value, x.to_numpy(zero_copy_only=False), side="right").astype(np.int32)), "int")(F.col(k))
    last = {r[0]: r[1] for r in keys.groupBy(number.alias("b")).agg(F.max(k)).collect()}  # a row for each range
    full = sorted(last)
    to = {last[b]: full[(i + 1) % len(full)] for i, b in enumerate(full)}
    own = rows.withColumn(bucket, number).withColumn(helper, F.lit(1))
    extra = rows.join(F.broadcast(spark.createDataFrame([*to.items()], f"{k} bigint, {bucket} int")), k).select(*rows.columns, bucket)  # a row for each range
    both = own.unionByName(extra.withColumn(helper, F.lit(0)))
    dealt = both.repartitionByRange(len(full), bucket).sortWithinPartitions(bucket, helper, k, t).select(key, t, bucket, helper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, prints = None, "", ""  # the row before in the range: its text and fingerprint
        for batch in batches:
            texts, ranges, kinds = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in passes(texts, PASS_CHARS // 2):
                other, mine = [], []
                for i in range(a, b):
                    if ranges[i] != at:
                        at, before = ranges[i], ""
                    other.append(before)
                    mine.append(edited(texts[i], before))
                    before = texts[i]
                made = fingerprints([*texts[a:b], *mine])
                fp, ep = made[: b - a], made[b - a :]
                following = [prints, *fp[:-1]]
                for i, x in enumerate(other):
                    if i == 0 and x == "":
                        following[0] = ""
                prints = fp[-1]
                keep = [i for i in range(b - a) if kinds[a + i]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(keep, pa.int64())),
                        pa.array([len(texts[a + i]) for i in keep], pa.int64()),
                        pa.array([hashlib.sha256(mine[i].encode("utf-8", "surrogatepass")).hexdigest() for i in keep], pa.string()),
                        pa.array([fp[i] for i in keep], pa.string()),
                        pa.array([ep[i] for i in keep], pa.string()),
                        pa.array([likeness(fp[i], ep[i]) for i in keep], pa.float64()),
                        pa.array([likeness(fp[i], following[i]) for i in keep], pa.float64()),
                    ],
                    names=schema.names,
                )

    return dealt.mapInArrow(run, schema)
