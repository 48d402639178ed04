"""Quality by ordinal cumulative-link regression on hashed-text weights.

One weight vector over hashed text scores a text: the words it holds with
stems of the longer ones, its character-class n-grams and its shape. Ordered
thresholds turn the score into probabilities of grades. The expected grade
ranks texts, and the probability of at least ``KEEP_GRADE`` selects them.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import stage

BUCKETS = 2048
#: Buckets of words, beside those of character classes, and lengths of stems.
WORD_BUCKETS = 1 << 15
STEMS = (5, 7)
SAMPLE_ROWS = 4000
KEEP_GRADE = 1
KEEP_PROBABILITY = 0.5
#: Buckets at the end that hold the text's overall shape.
_SHAPE = 64


def _classes() -> np.ndarray:
    """A class for each byte: letters by case, digits and spaces together, marks each its own."""
    out = np.ones(256, np.int64)  # lower-case letters, and bytes beyond ASCII
    for b in range(128):
        c = chr(b)
        out[b] = 2 if c.isupper() else 3 if c.isdigit() else 4 if c in " \t" else 5 if c in "\r\n" else 1 if c.isalpha() else 6 + b % 64
    return out


_CLASS = _classes()
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.int64)


def text_features(text: str | None) -> np.ndarray:
    """Square roots of bucket frequencies over the whole text, and one-hot shape buckets."""
    out = np.zeros(BUCKETS, np.float32)
    raw = text.encode() if text else b""
    body = BUCKETS - _SHAPE
    if raw:
        c = _CLASS[np.frombuffer(raw, np.uint8)]
        code, total = np.zeros(len(c), np.int64), np.zeros(body, np.int64)
        for n in range(3):
            if len(c) <= n:
                break
            code = code[: len(c) - n] * 71 + c[n:]
            total += np.bincount((code * _MIX[n] >> 16) % body, minlength=body)
        out[:body] = np.sqrt(total / len(c))
    words = raw.split()
    distinct = len(set(words)) / len(words) if words else 0.0
    mean = sum(map(len, words)) / len(words) if words else 0.0
    for k, x in enumerate((distinct * 15, mean, 1.5 * np.log1p(len(words)))):
        out[body + 16 * k + int(min(15, x))] = 1.0
    out[BUCKETS - 1] = not words
    return out


#: Buckets of usual words as a worker has met them, dropped when there are too many.
_KNOWN: dict[str, tuple[int, ...]] = {}
CACHE_ENTRIES, CACHED_CHARS = 200_000, 64


def _buckets(word: str) -> tuple[int, ...]:
    found = (crc32(word.encode()) % WORD_BUCKETS, *(crc32(word[:n].encode(), n) % WORD_BUCKETS for n in STEMS if len(word) > n))
    if len(word) <= CACHED_CHARS:
        _KNOWN[word] = found
    return found


def word_buckets(text: str | None) -> np.ndarray:
    """The buckets of the words that the whole text holds, and of their stems."""
    if len(_KNOWN) > CACHE_ENTRIES:
        _KNOWN.clear()
    found: set[int] = set()
    for w in set(_WORD.findall(text.lower())) if text else ():
        found.update(_KNOWN.get(w) or _buckets(w))
    return np.fromiter(found, np.int32, len(found))


class CumulativeLink:
    """P(grade <= k) = s(t_k - w x), with ordered thresholds t.

    A row's ``x`` is a dense part and a set of further features, each of which
    counts ``WORD_SCALE``.
    """

    WORD_SCALE = np.float32(0.5)

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, word_weights: np.ndarray | None = None):
        self.weights, self.thresholds = weights, thresholds
        self.word_weights = np.zeros(1, np.float32) if word_weights is None else word_weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, grades: int, held: list[np.ndarray] | None = None, steps: int = 200, rate: float = 0.05, decay: float = 2e-4, word_decay: float = 1e-3) -> CumulativeLink:
        """Adam on the negative log-likelihood with weight decay; the start and steps are fixed."""
        n, d = x.shape
        held = [np.zeros(0, np.int32)] * n if held is None else held
        rows, cols = np.repeat(np.arange(n), [len(h) for h in held]), np.concatenate(held)
        e = int(cols.max(initial=0)) + 1
        shrink = np.concatenate([np.full(d, decay), np.full(e, word_decay)])
        d += e
        # The first threshold and the logs of the gaps above it are free.
        free = np.concatenate([np.zeros(d), [-1.0], np.zeros(max(0, grades - 2))])
        m, v = np.zeros_like(free), np.zeros_like(free)
        for step in range(1, steps + 1):
            t = np.cumsum(np.concatenate([free[d : d + 1], np.exp(free[d + 1 :])]))
            s = x @ free[: d - e].astype(np.float32) + cls.WORD_SCALE * np.bincount(rows, free[d - e : d][cols], n)
            upper = np.where(y < grades - 1, t[np.minimum(y, grades - 2)], np.inf) - s
            lower = np.where(y > 0, t[np.maximum(y - 1, 0)], -np.inf) - s
            cu, cl = _sigmoid(upper), _sigmoid(lower)
            p = np.maximum(cu - cl, 1e-9)
            du, dl = cu * (1 - cu) / p, cl * (1 - cl) / p  # of log p by each end
            dt = np.zeros(grades - 1)
            np.add.at(dt, y[y < grades - 1], -du[y < grades - 1])
            np.add.at(dt, y[y > 0] - 1, dl[y > 0])
            later = np.cumsum(dt[::-1])[::-1]
            off = (du - dl) / n
            g = np.concatenate([x.T @ off.astype(np.float32), cls.WORD_SCALE * np.bincount(cols, off[rows], e), later / n])
            g[:d] += shrink * free[:d]
            g[d + 1 :] *= np.exp(free[d + 1 :])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            free = free - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        words = np.zeros(max(e, WORD_BUCKETS), np.float32)
        words[:e] = free[d - e : d]
        return cls(free[: d - e].astype(np.float32), np.cumsum(np.concatenate([free[d : d + 1], np.exp(free[d + 1 :])])), words)

    def scores(self, x: np.ndarray, held: list[np.ndarray] | None = None) -> np.ndarray:
        out = x @ self.weights
        return out if held is None else out + self.WORD_SCALE * np.array([self.word_weights[h].sum() for h in held], np.float32)

    def tails(self, x: np.ndarray, held: list[np.ndarray] | None = None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each row."""
        return 1 - _sigmoid(self.thresholds[None, :] - self.scores(x, held)[:, None])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for bad quality, 1 for good but toxic, 2 for good; repeated ids take the worst."""
    grade = F.col("quality").cast("int") * (2 - F.coalesce(F.col("toxic").cast("int"), F.lit(0)))
    rows = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").alias("rated_id"), grade.alias("grade"))
    return rows.groupBy("rated_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, most: int = SAMPLE_ROWS) -> CumulativeLink | None:
    """Fit on at most ``most`` rated documents with their whole texts; None without two grades.

    Of rows that share a rated id one counts, so what the driver gets is
    bounded by ``most`` rows of fixed features and each text's distinct words.
    """
    chosen = F.broadcast(stage.sampled(ratings, "rated_id", most))  # ``most`` rows bound it

    def run(batches):
        for b in stage.slices(batches, "text"):
            texts = b.column(1).to_pylist()
            x = [text_features(t).astype(np.float16).tobytes() + np.sort(word_buckets(t)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["doc_id", "grade", "x"])

    docs = docs.select("doc_id", "text")
    rated = docs.join(chosen, docs["doc_id"] == chosen["rated_id"]).select(docs["doc_id"].cast("long").alias("doc_id"), "text", "grade")
    rows = stage.map_batches(rated, run, "doc_id long, grade int, x binary")
    got = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("x").alias("x")).toPandas()
    got = got.sort_values("doc_id", ignore_index=True)
    if got.grade.nunique() < 2:
        return None
    dense = 2 * BUCKETS
    x = np.stack([np.frombuffer(r[:dense], np.float16) for r in got.x]).astype(np.float32)
    held = [np.frombuffer(r[dense:], np.int32) for r in got.x]
    return CumulativeLink.fit(x, got.grade.to_numpy(), int(got.grade.max()) + 1, held)


def graded_texts(docs: DataFrame, model: CumulativeLink | None, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) of each row of ``docs``.

    Null texts count as empty and are graded like any other text. Null ids and
    repeated rows keep their rows, further columns are not read, and an empty
    table gives an empty result. Without a model everything is kept with null
    grades.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in stage.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), *_grades(b.column(1), m, keep_grade, keep_probability)], names=["doc_id", "expected_grade", "tail_probability", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage.map_batches(rows, run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def _grades(texts: pa.Array, model: CumulativeLink | None, keep_grade: int, keep_probability: float) -> list[pa.Array]:
    n = len(texts)
    if model is None:
        return [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([True] * n)]
    texts = texts.to_pylist()
    tails = model.tails(np.stack([text_features(t) for t in texts]), [word_buckets(t) for t in texts])
    tail = tails[:, min(keep_grade, tails.shape[1]) - 1]
    return [pa.array(tails.sum(axis=1), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= keep_probability)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage.table(spark, sf_dir, "documents")
    return graded_texts(docs, fit(docs, graded(stage.table(spark, sf_dir, "labels"))))


def drop_bad(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model selects, in one pass over whole texts.

    Null and empty texts are graded like any other; null ids and repeated rows
    are judged by their own text; columns pass through under any name; without
    two grades, or from an empty table, all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, graded(labels)))
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in stage.slices(batches, "text"):
            keep = _grades(b.column(at), m, KEEP_GRADE, KEEP_PROBABILITY)[2]
            yield b.filter(keep)

    return stage.map_batches(docs, run, docs.schema)
