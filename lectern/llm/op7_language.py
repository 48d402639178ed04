"""Language of words and documents by a linear-chain conditional random field.

A word's emission is the sum of hashed weights of its affixes, its character
n-grams and itself, and of its place in a lexicon learned for each language.
Forward-backward over one chain of all words of a text, with learned
transitions, gives each word a distribution, so a text that switches language
is labelled word by word. A document's language has the greatest sum of word
posteriors. Transitions are learned from whole labelled texts and from chains
that switch between labelled texts of two languages.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import stage

BUCKETS = 1 << 15
SAMPLE_ROWS = 2000
#: Runs of words from each of two texts in a chain that switches.
SWITCH_RUN, SWITCH_RUNS = 12, 4
#: Words whose emissions a worker keeps, and characters of the longest of them.
CACHE_ENTRIES = 200_000
CACHED_CHARS = 64

_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case."""
    found = _WORD.findall(text.lower()) if text else []
    # The pattern also takes signs that count as numbers, such as a raised two.
    return found if all(map(str.isalpha, found)) else list(chain.from_iterable(map(_LETTERS.findall, found)))


def word_features(word: str) -> list[int]:
    """Buckets of the word itself, its prefixes and suffixes, and all its trigrams."""
    raw = word.encode()
    w = b"^" + raw + b"$"
    out = [crc32(raw)]
    out += [crc32(w[:k], 1) for k in (2, 3, 4)]
    out += [crc32(w[-k:], 2) for k in (2, 3, 4, 5)]
    out += [crc32(w[k : k + 3], 3) for k in range(len(w) - 2)]
    return [x % BUCKETS for x in out]


class Chains:
    """Chains of any lengths, longest first, laid out step by step: step k holds a row for each chain longer than k."""

    def __init__(self, lengths: list[int]):
        n = np.asarray(lengths, np.int64)
        self.order = np.argsort(-n, kind="stable")
        self.widths = np.searchsorted(-n[self.order], -np.arange(n.max(initial=0)), side="left")
        self.starts = np.concatenate([[0], np.cumsum(self.widths)])
        #: For each chain in the given order, where its words lie.
        self.places: list[np.ndarray] = [None] * len(n)
        for at, k in enumerate(self.order.tolist()):
            self.places[k] = self.starts[: n[k]] + at

    def steps(self):
        """(first row, rows) of each step."""
        return zip(self.starts[:-1].tolist(), self.widths.tolist(), strict=True)


class LanguageField:
    def __init__(self, languages: list[str], weights: np.ndarray, lexicon: dict[str, int], lexical: np.ndarray, first: np.ndarray, moves: np.ndarray):
        self.languages, self.weights, self.lexicon, self.lexical = languages, weights, lexicon, lexical
        self.first, self.moves = first, moves

    # -- fitting -----------------------------------------------------------
    @classmethod
    def fit(cls, texts: list[list[str]], labels: list[str], epochs: int = 3, batch: int = 48, rate: float = 0.05, decay: float = 1e-5) -> LanguageField:
        """Adam on the negative log-likelihood of whole texts and of chains that switch between two."""
        languages = sorted(set(labels))
        n = len(languages)
        y = np.array([languages.index(x) for x in labels])
        model = cls(languages, np.zeros((BUCKETS, n)), cls._lexicon(texts, y, n), np.zeros((n, n)), np.zeros(n), np.eye(n))
        rows = [(ws, np.full(len(ws), k)) for ws, k in zip(texts, y, strict=True)] + cls._switches(texts, y)
        r = np.random.default_rng(11)
        known: dict[str, list[int]] = {}
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.lexical, model.first, model.moves)]
        step = 0
        for _ in range(epochs):
            # Texts of about one length share a batch; the batches come in random order.
            order = sorted(r.permutation(len(rows)).tolist(), key=lambda k: len(rows[k][0]).bit_length())
            parts = [order[at : at + batch] for at in range(0, len(order), batch)]
            for b in r.permutation(len(parts)):
                part = [rows[k] for k in parts[b]]
                grads = model._gradient([ws for ws, _ in part], [g for _, g in part], known)
                step += 1
                for p, g, (m, v) in zip((model.weights, model.lexical, model.first, model.moves), grads, state, strict=True):
                    g = g / len(part) + decay * p
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return model

    @staticmethod
    def _lexicon(texts: list[list[str]], y: np.ndarray, n: int) -> dict[str, int]:
        """The language of each word that is frequent and nearly always in one language."""
        counts = [Counter() for _ in range(n)]
        for ws, k in zip(texts, y, strict=True):
            counts[k].update(ws)
        totals = [max(1, sum(c.values())) for c in counts]
        out = {}
        for w in {w for c in counts for w, k in c.items() if k >= 5}:
            rates = [c[w] / t for c, t in zip(counts, totals, strict=True)]
            best = int(np.argmax(rates))
            if rates[best] > 0.9 * sum(rates):
                out[w] = best
        return out

    @staticmethod
    def _switches(texts: list[list[str]], y: np.ndarray) -> list[tuple[list[str], np.ndarray]]:
        """Chains of runs from texts of two languages in turn, with each word's label; one for every eighth text."""
        r = np.random.default_rng(23)
        out = []
        for k in range(0, len(texts), 8):
            j = int(r.integers(len(texts)))
            if y[j] == y[k]:
                continue
            ws, gold = [], []
            for run in range(2 * SWITCH_RUNS):
                src = (k, j)[run % 2]
                at = int(r.integers(max(1, len(texts[src]) - SWITCH_RUN)))
                part = texts[src][at : at + SWITCH_RUN]
                ws += part
                gold += [y[src]] * len(part)
            out.append((ws, np.array(gold)))
        return out

    def _gradient(self, chains: list[list[str]], golds: list[np.ndarray], known: dict[str, list[int]] | None = None) -> tuple[np.ndarray, ...]:
        """Of the negative log-likelihood of chains with a label for each word."""
        n, known = len(self.languages), {} if known is None else known
        flat = [w for c in chains for w in c]
        for w in flat:
            if w not in known:
                known[w] = word_features(w)
        feats = [known[w] for w in flat]
        lens = np.array([len(f) for f in feats])
        idx = np.fromiter(chain.from_iterable(feats), np.int64, lens.sum())
        lex = np.array([self.lexicon.get(w, -1) for w in flat])
        laid = Chains([len(c) for c in chains])
        place = np.concatenate(laid.places)
        scores = np.empty((len(flat), n))
        scores[place] = self._scores(idx, lens, lex)
        post, pair = self.posteriors(scores, laid, pairs=True)
        gold = np.concatenate(golds)
        off = post[place] - np.eye(n)[gold]
        per = np.repeat(off, lens, axis=0)
        gw = np.stack([np.bincount(idx, per[:, k], BUCKETS) for k in range(n)], axis=1)
        gl = np.stack([np.bincount(lex[lex >= 0], off[lex >= 0, k], n) for k in range(n)], axis=1)
        seen = np.zeros((n, n))
        for g in golds:
            np.add.at(seen, (g[:-1], g[1:]), 1)
        starts = np.cumsum([0, *(len(c) for c in chains[:-1])])
        return gw, gl, off[starts].sum(axis=0), pair - seen

    # -- inference ---------------------------------------------------------
    def _scores(self, idx: np.ndarray, lens: np.ndarray, lex: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(self.weights[idx], np.concatenate([[0], np.cumsum(lens)[:-1]]), axis=0)
        out[lex >= 0] += self.lexical[lex[lex >= 0]]
        return out

    def emissions(self, ws: list[str]) -> np.ndarray:
        feats = [word_features(w) for w in ws]
        lens = np.array([len(f) for f in feats])
        idx = np.fromiter(chain.from_iterable(feats), np.int64, lens.sum())
        return self._scores(idx, lens, np.array([self.lexicon.get(w, -1) for w in ws]))

    def posteriors(self, scores: np.ndarray, laid: Chains, pairs: bool = False):
        """Forward-backward over chains of any lengths, whose words lie as ``laid`` says."""
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        t = np.exp(self.moves - self.moves.max())
        ahead, back = np.empty_like(e), np.ones_like(e)
        steps = list(laid.steps())
        before = None
        for at, w in steps:
            a = e[at : at + w]
            a = a * np.exp(self.first - self.first.max()) if before is None else a * (before[:w] @ t)
            a /= a.sum(axis=1, keepdims=True)
            ahead[at : at + w] = before = a
        for (at, _), (nxt, w) in zip(steps[-2::-1], steps[:0:-1], strict=True):
            b = (back[nxt : nxt + w] * e[nxt : nxt + w]) @ t.T
            b /= b.sum(axis=1, keepdims=True)
            back[at : at + w] = b  # chains that end here keep their ones
        post = ahead * back
        post /= post.sum(axis=1, keepdims=True)
        if not pairs:
            return post
        later = np.concatenate([np.arange(at, at + w) for at, w in steps[1:]]) if len(steps) > 1 else np.zeros(0, np.int64)
        earlier = later - np.repeat([w for _, w in steps[:-1]], [w for _, w in steps[1:]])
        joint = ahead[earlier, :, None] * t * (e * back)[later, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return post, joint.sum(axis=0)

    def label_words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, posterior) for each word of a text, code-switched or not."""
        ws = words(text)
        if not ws:
            return []
        post = self.chains([self.emissions(ws)])[0]
        best = post.argmax(axis=1)
        return [(w, self.languages[k], float(p[k])) for w, k, p in zip(ws, best, post, strict=True)]

    def chains(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Word posteriors of each text from its words' scores, each text as one chain."""
        laid = Chains([len(r) for r in rows])
        scores = np.empty((sum(map(len, rows)), len(self.languages)))
        scores[np.concatenate(laid.places)] = np.concatenate(rows)
        post = self.posteriors(scores, laid)
        return [post[p] for p in laid.places]


class _Emissions:
    """Emission scores of words, kept for those of usual length until the table is full."""

    def __init__(self, model: LanguageField):
        self.model, self.known = model, {}
        self.table, self.rows = np.zeros((1024, len(model.languages))), 0

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
            self.rows = 0
        new = list(dict.fromkeys(w for ws in texts for w in ws if w not in self.known))
        if new:
            while self.rows + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.rows : self.rows + len(new)] = self.model.emissions(new)
            self.known.update(zip(new, range(self.rows, self.rows + len(new)), strict=True))
            self.rows += len(new)
        get = self.known.__getitem__
        out = [self.table[np.fromiter(map(get, ws), np.int64, len(ws))] for ws in texts]
        for w in new:
            if len(w) > CACHED_CHARS:
                del self.known[w]
        return out


def held_out(column: str = "doc_id"):
    """Rows whose language is never read: crc32 of the id's text leaves 2 of 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, most: int = SAMPLE_ROWS) -> LanguageField | None:
    """Fit on the whole texts of at most ``most`` documents with a language that are not held out."""
    usable = docs.select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    got = stage.sampled(usable, "doc_id", most).toPandas()
    got = got.sort_values(["doc_id", "lang", "text"], ignore_index=True)
    rows = [(w, lang) for t, lang in zip(got.text, got.lang, strict=True) if (w := words(t))]
    return LanguageField.fit([w for w, _ in rows], [x for _, x in rows]) if rows else None


def languages(docs: DataFrame, model: LanguageField | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs``.

    ``und`` with score 0 for null texts, texts without a letter, and all texts
    without a model. Null ids are not held out and keep their rows, as repeated
    rows do; further columns are not read; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        cache = _Emissions(m) if m else None
        for b in stage.slices(batches, "text", 2_000_000):
            texts = [words(t) for t in b.column(2).to_pylist()]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            full = [k for k, ws in enumerate(texts) if ws] if m else []
            if full:
                for k, post in zip(full, m.chains(cache.of([texts[k] for k in full])), strict=True):
                    share = post.mean(axis=0)
                    best = int(share.argmax())
                    langs[k], scores[k] = m.languages[best], float(min(1.0, share[best]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return stage.map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage.table(spark, sf_dir, "documents")
    return languages(docs, fit(docs))
