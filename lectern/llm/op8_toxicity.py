"""Toxicity by a counterfactual-regularised linear classifier.

A logistic model over the words a text holds is fitted with an L1 term and a
penalty on the squared change of its score when identity terms in a labelled
sentence are swapped for others. So a term that merely names a group draws no
weight of its own, however often it stands in toxic sentences.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import stage

SAMPLE_ROWS = 10_000
LEAST_DOCS = 3
COUNTERFACTUAL = 4.0
L1 = 1.5e-4
#: Weight of a toxic row in the fit: they are few, and missing one costs more.
TOXIC_WEIGHT = 2.0
#: Lengths of the stems that stand beside a word, for inflected and compound forms.
STEMS = (5, 7)

#: Terms that name groups of people, by what they tell apart.
IDENTITY_TERMS = {
    "gender": "woman women man men girl boy female male femme femmes homme hommes frau frauen mann männer mujer mujeres hombre hombres transgender",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer homosexuel lesbienne schwul lesbisch homosexuell gays lesbiana",
    "faith": "muslim muslims christian christians jewish jew jews hindu buddhist catholic atheist musulman chrétien juif moslem christ jude musulmán cristiano judío",
    "origin": "black white asian african european american arab indian mexican chinese immigrant immigrants refugee refugees noir blanc schwarz weiß negro blanco",
    "body": "blind deaf disabled old young elderly aveugle sourd handicapé taub behindert ciego sordo",
}
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(found: set[str]) -> set[str]:
    """The words, and the stems of longer ones, marked by a star."""
    stems = {w[:n] + "*" for w in found if len(w) > 5 for n in STEMS if len(w) > n}
    return found | stems


def swaps(found: set[str]) -> list[tuple[set[str], set[str]]]:
    """(terms that leave, terms that come) for each identity swap of a text's words."""
    out = []
    for terms in IDENTITY_TERMS.values():
        group = terms.split()
        here = [t for t in group if t in found]
        if here:
            out += [(set(here), {t}) for t in group if t not in found]
    return out


class SwapRegularised:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, texts: list[str | None], y: list[int], penalty: float = COUNTERFACTUAL, l1: float = L1, steps: int = 250, rate: float = 0.1) -> SwapRegularised:
        """Proximal Adam; all is fixed by the rows and their order."""
        # Two passes, so that no text's words are held but as numbers.
        seen = Counter()
        for t in texts:
            seen.update(features(words(t)))
        vocabulary = {w: k for k, w in enumerate(sorted(w for w, c in seen.items() if c >= LEAST_DOCS))}
        del seen
        lists, moved = [], []
        for t in texts:
            found = words(t)
            own = features(found)
            lists.append(np.array(sorted(vocabulary[w] for w in own if w in vocabulary), np.int32))
            for gone, come in swaps(found):
                other = features((found - gone) | come)
                moved.append(tuple([vocabulary[w] for w in x if w in vocabulary] for x in (own - other, other - own)))
        rows, cols = _pairs(lists)
        target = np.array(y, np.float64)
        weight = np.where(target > 0, TOXIC_WEIGHT, 1.0)
        # Only swaps that touch a known word can change a score.
        moved = [m for m in moved if m[0] or m[1]]
        out_rows, out_cols = _pairs([m[0] for m in moved])
        in_rows, in_cols = _pairs([m[1] for m in moved])
        n, d, k = len(texts), len(vocabulary), max(1, len(moved))
        w = np.zeros(d)
        base = min(max(target.mean(), 1e-3), 1 - 1e-3)
        bias = np.log(base / (1 - base))
        m, v = np.zeros(d + 1), np.zeros(d + 1)
        for step in range(1, steps + 1):
            z = np.bincount(rows, w[cols], n) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight / n
            g = np.bincount(cols, err[rows], d)
            if moved:
                change = np.bincount(in_rows, w[in_cols], len(moved)) - np.bincount(out_rows, w[out_cols], len(moved))
                pull = 2 * penalty * change / k
                g = g + np.bincount(in_cols, pull[in_rows], d) - np.bincount(out_cols, pull[out_rows], d)
            g = np.append(g, err.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
            move = scale * m / (1 - 0.9**step)
            w = w - move[:d]
            w = np.sign(w) * np.maximum(np.abs(w) - scale[:d] * l1, 0)
            bias -= move[d]
        return cls({t: float(w[i]) for t, i in vocabulary.items() if w[i]}, float(bias))

    def score(self, text: str | None) -> float:
        found = features(words(text))
        z = self.bias + sum(self.weights[t] for t in sorted(self.weights.keys() & found))
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def _pairs(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    parts = [np.sort(np.asarray(x, np.int32)) for x in lists]
    return rows, np.concatenate(parts) if parts else np.zeros(0, np.int32)


def held_out(column: str = "doc_id"):
    """Rows whose labels are never read: crc32 of the id's text divisible by five."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> SwapRegularised | None:
    """Fit on at most ``most`` labelled documents that are not held out; None without both labels.

    The model sees a text only as the set of its words, so that is what the
    driver gets of each, however long the text. Of rows that share a labelled
    id one counts, so at most ``most`` rows reach the driver.
    """
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
    usable = usable.groupBy(F.col("doc_id").alias("rated_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(stage.sampled(usable, "rated_id", most))  # ``most`` rows bound it
    docs = docs.select("doc_id", "text")
    rows = docs.join(chosen, docs["doc_id"] == chosen["rated_id"]).select(docs["doc_id"].cast("long").alias("doc_id"), "toxic", "text")

    def run(batches):
        for b in stage.slices(batches, "text"):
            held = [" ".join(sorted(words(t))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held)], names=["doc_id", "toxic", "held"])

    rows = stage.map_batches(rows, run, "doc_id long, toxic int, held string")
    got = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("held").alias("held")).toPandas()
    got = got.sort_values("doc_id", ignore_index=True)
    if got.toxic.nunique() < 2:
        return None
    return SwapRegularised.fit(got.held.tolist(), got.toxic.tolist())


def toxicity(docs: DataFrame, model: SwapRegularised | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Null and empty texts have the model's score for no words. Null ids are not
    held out; repeated rows keep their rows; further columns are not read; an
    empty table gives an empty result. Without a model every score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in stage.slices(batches, "text"):
            s = [m.score(t) if m else 0.0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return stage.map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage.table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, stage.table(spark, sf_dir, "labels")))
