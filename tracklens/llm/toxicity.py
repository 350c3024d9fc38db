"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two letter strings is the gap-weighted count of the letter subsequences of length ORDER that they share
within SPAN letters, divided by both strings' norms, so an insult still matches with letters put in between, with
marks between its letters (only letters count) or with endings of its own; runs of single letters are read as one
word, long words in windows. A sentence's kernel with a landmark is that of its most similar word, or 0 below FLOOR.

Learning, from a bounded sample of labelled documents:
1. Landmarks: letter strings of the sentences' words, chosen one by one by the likelihood ratio between toxic
   and clean documents, over words that no earlier landmark explains. Copies of a document count as one.
2. Training sentences: all sentences of clean documents, and of toxic documents those that hold a landmark, since a
   toxic document says only that some sentence of it is; besides, their words with a letter put in.
3. A squared-hinge machine on the sentences' Nyström features K(x, L) K(L, L)^-1/2, and a logistic curve that turns
   a document's highest sentence into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, sliced, with_fields

ORDER = 4
SPAN = 7
DECAY = 0.7
BUCKETS = 1 << 20
#: Longer runs of letters are read in windows of so many, which overlap by half.
LONGEST = 24
SHORTEST = 3
#: Bounds on what is learned from: toxic and clean documents, characters of each, and landmarks.
TRAIN_TOXIC = 1000
TRAIN_CLEAN = 4000
TRAIN_CHARS = 10_000
LANDMARKS = 96
#: Variants with a letter put in: at most so many of a word, and about so many in all.
VARIANTS, ALL_VARIANTS = 8, 400
#: Lower kernel values count as 0.
FLOOR = 0.35
#: Lengths of landmark strings, and the likelihood ratio statistic that one must reach.
LENGTHS = range(4, 11)
EVIDENCE = 22.0
#: Marks of a word's start and end, which are letters to the kernel.
START, END = "^", "$"
#: Words, and words that are similar to a landmark, that a worker's table holds before it starts anew.
TABLE_WORDS, TABLE_ROWS = 500_000, 50_000
THRESHOLD = 0.3

_offsets = [c for c in combinations(range(SPAN), ORDER) if c[0] == 0]
_word = re.compile(r"[^\W\d_]+(?:[^\w\s]+[^\W\d_]+)*")
_spelled = re.compile(r"(?<!\w)(?:[^\W\d_][^\w\n]{1,2}){2,}[^\W\d_](?!\w)")
_mark = re.compile(r"[\W\d_]+")
_ends = re.compile(r"(?<=[.!?])\s+|\n+")


def words(low: str) -> list[str]:
    """Letter strings of a lower-case text; marks inside a chunk are dropped, and each part stands alone too."""
    out = []
    for w in _word.findall(low):
        if w.isalpha():
            out.append(w)
        else:
            parts = _mark.split(w)
            out += parts
            out.append("".join(parts))
    return out


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of a whole text, and spelled-out words, which may have stops inside, as sentences of their own."""
    low = text.lower()
    out = [words(x) for x in _ends.split(low)]
    out += [[_mark.sub("", m)] for m in _spelled.findall(low)]
    return [x for x in out if x]


def windows(word: str) -> list[str]:
    word = START + word + END
    if len(word) <= LONGEST:
        return [word]
    return [word[a : a + LONGEST] for a in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, bucket, weight) of the subsequences of all strings, one entry for each occurrence."""
    lens = np.array([len(s) for s in strings], dtype=np.int64)
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(strings)), lens)
    who, bucket, weight = [], [], []
    for at in _offsets:
        n = len(points) - at[-1]
        if n <= 0:
            continue
        inside = np.flatnonzero(owner[:n] == owner[at[-1] :])
        code = np.zeros(len(inside), dtype=np.uint64)
        for o in at:
            code = (code + points[inside + o] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        who.append(owner[inside])
        bucket.append((code >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
        weight.append(np.full(len(inside), DECAY ** (at[-1] - ORDER + 1)))
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(x) if x else empty for x in (who, bucket, weight))  # type: ignore[return-value]


class Landmarks:
    """Strings and their features, each of norm one: a row for each bucket that any of them has."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = strings
        who, bucket, weight = subsequences(strings)
        used = np.unique(bucket)
        self.index = np.full(BUCKETS, -1, dtype=np.int32)
        self.index[used] = np.arange(len(used))
        self.rows = np.zeros((len(used), len(strings)))
        np.add.at(self.rows, (self.index[bucket], who), weight)
        self.rows /= np.maximum(1e-12, np.sqrt((self.rows**2).sum(axis=0, keepdims=True)))

    def kernel(self, strings: list[str]) -> np.ndarray:
        """Kernel of each word with each landmark; a longer word has its windows' highest, what is below FLOOR is 0."""
        cut = [windows(s) for s in strings]
        out = np.zeros((len(strings), self.rows.shape[1]))
        who, bucket, weight = subsequences([*chain.from_iterable(cut)])
        at = self.index[bucket]
        hit = at >= 0
        some, place = np.unique(who[hit], return_inverse=True)
        if not len(some):
            return out
        value = np.zeros((len(some), out.shape[1]))
        np.add.at(value, place, weight[hit, None] * self.rows[at[hit]])
        own = np.isin(who, some)
        code, inverse = np.unique(who[own] * BUCKETS + bucket[own], return_inverse=True)
        square = np.bincount(inverse, weights=weight[own], minlength=len(code)) ** 2
        norm = np.sqrt(np.bincount(np.searchsorted(some, code // BUCKETS), weights=square, minlength=len(some)))
        owner = np.repeat(np.arange(len(strings)), [len(c) for c in cut])[some]
        np.maximum.at(out, owner, value / norm[:, None])
        out[out < FLOOR] = 0.0
        return out


class Model:
    """value of a sentence = kernel row . weights + offset; without landmarks every text has the base rate."""

    def __init__(self, marks: Landmarks | None, weights: np.ndarray, offset: float, slope: float, base: float) -> None:
        self.marks, self.weights, self.offset, self.slope, self.base = marks, weights, offset, slope, base

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.base, -30, 30)))


class Known(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row


class Scorer:
    """A worker's table of words and, of those similar to a landmark, their kernel rows; a text's value is its highest sentence's."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known, self.place = Known(), np.zeros(0, dtype=np.int32)
        self.rows = np.zeros((1, len(self.model.weights)))

    def kernel_rows(self, texts: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel rows of the texts' sentences that have a word similar to a landmark, and which text each is of."""
        if len(self.known) > TABLE_WORDS or len(self.rows) > TABLE_ROWS:
            self.clear()
        sizes = [len(s) for t in texts for s in t]
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(chain.from_iterable(texts))), dtype=np.int64, count=sum(sizes))
        new, self.known.new = self.known.new, []
        for a in range(0, len(new), 20_000):
            made = self.model.marks.kernel(new[a : a + 20_000])
            some = made.any(axis=1)
            self.place = np.concatenate([self.place, np.where(some, len(self.rows) - 1 + np.cumsum(some), 0).astype(np.int32)])
            self.rows = np.concatenate([self.rows, made[some]])
        at = self.place[ids]
        sentence = np.repeat(np.arange(len(sizes)), sizes)[at > 0]
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        starts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.zeros(0, dtype=np.int64)
        return (np.maximum.reduceat(self.rows[at[at > 0]], starts, axis=0) if len(starts) else self.rows[:0]), text[sentence[starts]]

    def best(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.model.offset)
        if self.model.marks:
            rows, text = self.kernel_rows([sentences(t) for t in texts])
            np.maximum.at(out, text, rows @ self.model.weights + self.model.offset)
        return out


# -- learning -------------------------------------------------------------------------------------------------


def families(bags: list[np.ndarray], rng: np.random.Generator, tries: int = 6) -> np.ndarray:
    """A number for each document that its near copies share: those that agree on two smallest hashed words in some try."""
    top = 1 + max((int(b.max()) for b in bags if len(b)), default=0)
    of = np.arange(len(bags))
    for _ in range(tries):
        a, b = rng.permutation(top), rng.permutation(top)
        seen: dict[tuple[int, int], int] = {}
        for d, bag in enumerate(bags):
            if len(bag) >= 4:
                first = seen.setdefault((int(a[bag].min()), int(b[bag].min())), d)
                if of[first] != of[d]:
                    of[of == of[d]] = of[first]
    return of


def grams(strings: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, string, start) of all substrings of a length."""
    lens = np.array([len(s) for s in strings], dtype=np.int64)
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(strings), dtype=np.int64), lens)
    first = np.cumsum(lens) - lens
    m = len(points) - length + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.flatnonzero(owner[:m] == owner[length - 1 :])
    code = np.full(len(inside), length, dtype=np.uint64)
    for k in range(length):
        code = (code + points[inside + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    return code, owner[inside], inside - first[owner[inside]]


def evidence(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Likelihood ratio statistic of a toxic and b clean families against `share`; 0 where toxic ones are no more than expected."""
    n = np.maximum(a + b, 1e-9)
    g = 2 * (a * np.log(np.maximum(a, 1e-9) / (n * share)) + b * np.log(np.maximum(b, 1e-9) / (n * (1 - share))))
    return np.where(a > n * share, g, 0.0)


def spread(code: np.ndarray, word: np.ndarray, at: np.ndarray, family: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, word, family) for each family that has the word; at: where the families of a word start."""
    n = at[word + 1] - at[word]
    rows = np.repeat(at[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(code, n), np.repeat(word, n), family[rows]


def cover(bags: list[np.ndarray], toxic: np.ndarray, vocabulary: list[str], most: int) -> list[str]:
    """Strings that tell toxic from clean documents, at most `most`."""
    own = families(bags, np.random.default_rng(3))
    sizes = [len(b) for b in bags]
    word = np.concatenate(bags) if bags else np.zeros(0, np.int64)
    family, bad = np.repeat(own, sizes), np.repeat(toxic, sizes)
    shown = [START + w + END for w in vocabulary]

    def side(of_toxic: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = np.unique(word[bad == of_toxic] * len(bags) + family[bad == of_toxic])
        w = pairs // len(bags)
        return np.unique(w), np.searchsorted(w, np.arange(len(vocabulary) + 1)), pairs % len(bags)

    tox_words, tox_at, tox_family = side(True)
    clean_words, clean_at, clean_family = side(False)
    n_toxic, n_clean = len(np.unique(own[toxic])), len(np.unique(own[~toxic]))
    if not n_toxic or not n_clean:
        return []
    share = n_toxic / (n_toxic + n_clean)
    n_docs = len(bags)
    text_of: list[str] = []
    counts, ks, ws, fs = [], [], [], []
    tox_shown = [shown[w] for w in tox_words.tolist()]
    for length in LENGTHS:  # one length at a time, and of each only the strings with evidence, for memory's sake
        code, string, start = grams(tox_shown, length)
        c, w, f = spread(code, tox_words[string], tox_at, tox_family)
        seen, index = np.unique(c, return_inverse=True)
        count = np.bincount(np.unique(index * n_docs + f) // n_docs, minlength=len(seen))
        live = evidence(count.astype(float), np.zeros(len(count)), share) >= EVIDENCE
        if not live.any():
            continue
        keep = live[index]
        number = np.cumsum(live) - 1 + len(text_of)
        codes = seen[live]
        where = dict(zip(*(x[np.isin(code, codes)][::-1].tolist() for x in (code, np.arange(len(code)))), strict=True))
        text_of += [tox_shown[string[where[x]]][start[where[x]] : start[where[x]] + length] for x in codes.tolist()]
        ks.append(number[index[keep]])
        ws.append(w[keep])
        fs.append(f[keep])
        against = np.zeros(len(codes))
        for a in range(0, len(clean_words), 20_000):
            some = clean_words[a : a + 20_000]
            cc, cs, _ = grams([shown[x] for x in some.tolist()], length)
            at = np.minimum(np.searchsorted(codes, cc), len(codes) - 1)
            hit = codes[at] == cc
            x, _, y = spread(at[hit], some[cs[hit]], clean_at, clean_family)
            found = np.unique(x.astype(np.int64) * n_docs + y) // n_docs
            against += np.bincount(found, minlength=len(codes))  # a family that has it in two blocks counts twice, against it
        counts.append(against)
    if not ks:
        return []
    k, w, f, against = (np.concatenate(x) for x in (ks, ws, fs, counts))
    pair = w * n_docs + f
    lengths = np.array([len(t) for t in text_of])
    live = text_of
    out: list[str] = []
    while len(out) < most and len(k):
        got = np.unique(k * len(bags) + f) // len(bags)
        value = evidence(np.bincount(got, minlength=len(live)).astype(float), against, share)
        if value.max() < EVIDENCE:
            break
        best = int(np.lexsort((-lengths, -value.round(6)))[0])
        out.append(text_of[best])
        rest = ~np.isin(pair, pair[k == best])
        k, f, pair = k[rest], f[rest], pair[rest]
    return out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps, each cut until the loss falls."""
    x = np.hstack([x, np.ones((len(x), 1))])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    loss = lambda w: w @ reg @ w + c * (weight * np.maximum(0.0, 1 - y * (x @ w)) ** 2).sum()
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        on = 1 - y * (x @ w) > 0
        xo, wo = x[on], c * weight[on]
        step = np.linalg.solve(reg + xo.T @ (wo[:, None] * xo), xo.T @ (wo * y[on])) - w
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if now - new <= 1e-9 * now:
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


def learn(documents: list[list[list[str]]], toxic: np.ndarray, most: int = LANDMARKS) -> Model:
    """From documents as sentences of words, and which of them are toxic."""
    base_rate = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 0.5))
    flat = Model(None, np.zeros(0), 0.0, 0.0, float(np.log(base_rate / (1 - base_rate))))
    row_of: dict[str, int] = {}
    bags = [np.array(sorted({row_of.setdefault(w, len(row_of)) for s in d for w in s if len(w) >= SHORTEST}), dtype=np.int64) for d in documents]
    chosen = cover(bags, toxic, list(row_of), most)
    if not chosen:
        return flat
    marks = Landmarks(chosen)
    value, vector = np.linalg.eigh(marks.rows.T @ marks.rows)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    scorer = Scorer(Model(marks, np.zeros(len(chosen)), 0.0, 0.0, 0.0))
    holds = {w for w in row_of if any(m in START + w + END for m in chosen)}
    witness = [[[w for w in s] for s in d if y and any(w in holds for w in s)] for d, y in zip(documents, toxic.tolist(), strict=True)]
    positive, _ = scorer.kernel_rows(witness)
    negative, _ = scorer.kernel_rows([d for d, y in zip(documents, toxic.tolist(), strict=True) if not y])
    rng = np.random.default_rng(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    insults = sorted({w for d in witness for s in d for w in s if w in holds})
    gapped = []
    for s in insults:
        for _ in range(max(1, min(VARIANTS, ALL_VARIANTS // len(insults)))):  # more variants of each where words are few
            k = int(rng.integers(2, max(3, len(s) - 1)))
            gapped.append(s[:k] + letters[int(rng.integers(len(letters)))] + s[k:])
    variant = marks.kernel(gapped)
    rows, weight = [], []
    # sentences like no landmark are many, and all alike: together they weigh as much as the positive ones
    for own, total in ((positive, len(positive)), (variant, 0.5 * len(positive)), (negative, len(negative)), (np.zeros((1, len(chosen))), len(positive))):
        different, count = np.unique(own, axis=0, return_counts=True)
        rows.append(different)
        weight.append(count * total / max(1, count.sum()))
    y = np.repeat([1.0, 1.0, -1.0, -1.0], [len(r) for r in rows])
    w, b = machine(np.concatenate(rows) @ root, y, np.concatenate(weight))
    model = Model(marks, root @ w, b, 0.0, 0.0)
    scorer = Scorer(model)
    found, text = scorer.kernel_rows(documents)
    best = np.full(len(documents), b)
    np.maximum.at(best, text, found @ model.weights + b)
    model.slope, model.base = curve(best, toxic.astype(float))
    return model


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve, by damped Newton steps; slope is not negative."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        q = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * x * x).sum() + 0.01, (q * x).sum()], [(q * x).sum(), q.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a)), float(b)


def fit(df: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, chars: int = TRAIN_CHARS) -> Model:
    """Learns from at most `toxic` and `clean` labelled documents, chosen by the hash of their keys; those of more than `chars` characters are left out.

    learn_from: which rows of labels may be used. Rows with a null key or label, labels without a document and
    null texts teach nothing; a key with several labels counts as toxic if any of them says so. Without toxic
    documents every score is the base rate. The driver gets the sample's texts, (toxic + clean) * chars
    characters at most where keys don't repeat.
    """
    spark = df.sparkSession
    given = labels.where(learn_from & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).alias("y"))
    turn = F.xxhash64("k")
    picked = given.where("y").orderBy(turn, "k").limit(toxic).collect() + given.where("not y").orderBy(turn, "k").limit(clean).collect()
    small = F.broadcast(spark.createDataFrame([tuple(r) for r in picked], given.schema))  # at most toxic + clean rows
    sample = df.where(F.length(text) <= chars).select(F.col(key).alias("k"), F.col(text).alias("t")).join(small, "k").limit(2 * (toxic + clean)).collect()
    rows = sorted(sample, key=lambda r: (str(r["k"]), r["t"]))
    return learn([sentences(r["t"]) for r in rows], np.array([r["y"] for r in rows], dtype=bool))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with toxic_score, the probability that its label is 1, from the text alone; a column of this name is replaced.

    Null and empty texts and texts without a word have the score of a document without insults, as has a text that is
    similar to no landmark. Repeated rows have equal scores. Narrow.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(df, toxic_score=T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, out = Scorer(sent.value), None
        for batch, texts in sliced(batches, text):
            out = out or pa.schema([f for f in batch.schema if f.name.lower() != "toxic_score"] + [pa.field("toxic_score", pa.float64())])
            yield appended(batch, out, toxic_score=pa.array(sent.value.probability(scorer.best(texts))))

    return df.mapInArrow(run, schema)
