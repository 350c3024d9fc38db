"""Language identification with blended-spectrum presence kernels.

k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|) over the sets G of hashed 1- to 3-grams of lower-cased letters
(other marks count as a space). Landmarks, a few training documents of each language, give the Nyström map
K(x, L) K(L, L)^-1/2; one-versus-rest kernel ridge regression on it is a small linear system. A batch is
scored by two matrix products: presence rows by landmark rows, then by the folded weights.

Training documents become bitsets of a fixed size on the executors, so the driver gets TRAIN_PER_LANGUAGE
(about) of them for each language however long their texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import appended, sliced, with_fields

BUCKETS = 1 << 16
GRAMS = 3
#: Bounds on what is learned from: documents of each language, and landmarks of each.
TRAIN_PER_LANGUAGE = 150
LANDMARKS_PER_LANGUAGE = 20
RIDGE = 1e-2
SHARPNESS = 6.0
ROWS = 64  # documents of one presence matrix
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Presence matrix (texts x BUCKETS, uint8) and whether a text has a letter."""
    lowered = [t.lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.array([len(t) for t in lowered])
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lens)
    letter = letters()[points]
    c = np.where(letter, points, 32).astype(np.uint32)
    out = np.zeros(len(texts) * BUCKETS, dtype=np.uint8)
    base = doc * BUCKETS
    code = np.zeros(len(c), dtype=np.uint32)
    for n in range(GRAMS):
        code = code[: len(c) - n] * np.uint32(0x01000193) + c[n:] + np.uint32(1)
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        inside = base[: len(code)]
        # the space after each text keeps a gram that leaves it from being more than one that ends in spaces
        same = doc[: len(code)] == doc[n:]
        at = inside + (mixed >> np.uint32(16)).astype(np.int64)
        out[at if same.all() else at[same]] = 1
    has = np.logical_or.reduceat(letter, np.cumsum(lens) - lens) if len(texts) else np.zeros(0, dtype=bool)
    return out.reshape(len(texts), BUCKETS), has


class Model:
    """Languages, the buckets that landmarks have, landmark rows over these and the folded weights."""

    def __init__(self, languages: list[str], rows: np.ndarray, target: np.ndarray, per_language: int, ridge: float) -> None:
        self.languages = languages
        if not len(rows):
            return
        picked = np.concatenate([np.flatnonzero(target == k)[:per_language] for k in range(len(languages))])
        marks = rows[picked].astype(np.float32)
        self.buckets = np.flatnonzero(marks.any(axis=0))
        size = np.sqrt(marks.sum(axis=1))
        self.marks = np.ascontiguousarray((marks[:, self.buckets] / size[:, None]).T)
        within = (self.marks.T @ self.marks).astype(np.float64)
        value, vector = np.linalg.eigh(within)
        good = value > 1e-8 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        x = self._similar(rows) @ root
        y = np.where(target[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
        weight = 1.0 / np.bincount(target, minlength=len(languages))[target]  # languages count alike
        weight *= len(target) / weight.sum()
        mean = (weight[:, None] * y).sum(axis=0) / weight.sum()
        xw = x * weight[:, None]
        solved = np.linalg.solve(x.T @ xw + ridge * len(x) / 100 * np.eye(x.shape[1]), xw.T @ (y - mean))
        self.weights, self.mean = root @ solved, mean

    def _similar(self, rows: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1, np.count_nonzero(rows, axis=1)))
        return (rows[:, self.buckets].astype(np.float32) @ self.marks) / size[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """A language, a score in [0, 1] and the share of its n-grams that landmarks have, for each text."""
        names, scores, known = [], np.zeros(len(texts)), np.zeros(len(texts))
        for a in range(0, len(texts), ROWS):
            rows, has = presence(texts[a : a + ROWS])
            if not self.languages:
                names += [UNKNOWN] * len(rows)
                continue
            s = self._similar(rows) @ self.weights + self.mean
            e = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
            best = s.argmax(axis=1)
            scores[a : a + len(rows)] = np.where(has, 1.0 / e.sum(axis=1), 0.0)
            names += [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
            known[a : a + len(rows)] = rows[:, self.buckets].sum(axis=1) / np.maximum(1, np.count_nonzero(rows, axis=1))
        return names, scores, known


def fit(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Learns from about per_language different texts of each language among the rows where learn holds.

    Rows with a null language or text, or without a letter, teach nothing. The choice is by the text's hash,
    so copies of a text count once and a run on the same rows gives the same model. Without any such row the
    model knows no language.
    """
    own = df.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    counts = {r[0]: r[1] for r in own.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}  # a row per language
    if not counts:
        return Model([], np.zeros((0, BUCKETS), np.uint8), np.zeros(0, int), landmarks, ridge)
    span = 1 << 30
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(span * min(1.0, 1.25 * per_language / max(1, n))))))
    chosen = own.where(F.pmod("h", F.lit(span)) < share[F.col("lang")]).dropDuplicates(["lang", "h"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text"):
            for a in range(0, len(texts), ROWS):
                rows, _ = presence(texts[a : a + ROWS])
                packed = np.packbits(rows, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(rows)), batch.column(1).slice(a, len(rows)), pa.array([r.tobytes() for r in packed], pa.binary())], names=["lang", "h", "bits"])

    found = sorted(map(tuple, chosen.select("lang", "h", "text").mapInArrow(bits, "lang string, h bigint, bits binary").collect()))
    languages = sorted({r[0] for r in found})
    rows = np.unpackbits(np.stack([np.frombuffer(r[2], dtype=np.uint8) for r in found]), axis=1)
    return Model(languages, rows, np.array([languages.index(r[0]) for r in found]), landmarks, ridge)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, lang_score and lang_known, from the text alone; columns of these names are replaced.

    `und` with score 0 where the text is null or has no letter, or the model knows no language. The score weighs the
    learned languages against each other; lang_known, the share of the text's n-grams that landmarks have, says
    whether it is one of them at all. Narrow.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(df, lang_pred=T.StringType(), lang_score=T.DoubleType(), lang_known=T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = sent.value, None
        for batch, texts in sliced(batches, text):
            names, scores, known = own.predict(texts)
            out = out or to_arrow_schema(schema)
            yield appended(batch, out, lang_pred=pa.array(names, pa.string()), lang_score=pa.array(scores), lang_known=pa.array(known))

    return df.mapInArrow(run, schema)


def remainder(key: Column, by: int) -> Column:
    """crc32 of a key's decimal text modulo by; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by
