"""Personal data by patterns and a character-level BiLSTM with CRF transitions.

Base spans come from fixed patterns and their checks. A bidirectional LSTM over
characters with a CRF on top, written in numpy and trained from labelled spans,
reads overlapping windows for what the patterns miss: spelled-out and bracketed
addresses, numbers with other separators, telephone numbers without a plus.
Spans cut by a window's edge are joined with those of its neighbours, and those
of a whole text are reconciled together by the best total weight without
overlap. What passes the check of its kind and touches no base span is added.

A span that passes has at most ``MOST_CHARS`` characters and holds a digit, an
at sign or a spelled one, so windows further than that from all of these can
add nothing and are not decoded; all other windows of the whole text are.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import stage

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
HIDDEN, EMBED = 16, 12
BATCH = 1024

# Base patterns. A match can only start where a run of digits starts, which the
# look-behind says outright; it spares a retry at every digit of a long run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
_HOT = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]|\bat\b(?=.{1,80}?\bdot\b)", re.IGNORECASE)
#: Spelled signs, and what is left of each kind once they are brought to plain ones.
_AT = re.compile(r"\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\s(?:at|@)\s", re.IGNORECASE)
_DOT = re.compile(r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s(?:dot|\.)\s", re.IGNORECASE)
_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_CARD_LIKE = re.compile(r"[0-9](?:[ ./_-]{0,3}[0-9])+")
_PHONE_LIKE = re.compile(r"(?=.*[0-9][ ().,/-]+[0-9])\+?\(?[0-9](?:[ ()./-]{0,3}[0-9])+")
#: Characters of the longest span that is added.
MOST_CHARS = 254
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                yield start, last
        at = text.find("@", at + 1)


def valid(kind: str, s: str) -> bool:
    """The check that an added span's text must pass for its kind."""
    if len(s) > MOST_CHARS or not _HOT.search(s):
        return False
    if kind == "email":
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", s))))
    if kind == "ip":
        parts = _DOT.sub(".", s).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = _DIGITS.sub("", s)
    if kind == "card":
        return 13 <= len(digits) <= 19 and bool(_CARD_LIKE.fullmatch(s)) and luhn(digits)
    return 9 <= len(digits) <= 15 and bool(_PHONE_LIKE.fullmatch(s))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the fixed patterns: leftmost, not overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not _MARKED.search(text):
        return out
    out["email"] = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


# -- the network -----------------------------------------------------------
_ALPHABET = {c: 2 + k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0@.-+() _%:/#,\n[]{}")}
SYMBOLS = 2 + len(_ALPHABET)
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _symbols(text: str) -> np.ndarray:
    """0 is padding, 1 any other character; digits share a symbol, letters their case."""
    get = _ALPHABET.get
    return np.array([get("0" if "0" <= c <= "9" else c, 1) for c in text.lower()] if len(text) == len(text.lower()) else [get("0" if "0" <= c <= "9" else c.lower(), 1) for c in text], np.int64)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """BiLSTM emissions and CRF transitions over batches of equal windows."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        self.p = {"emb": r.normal(0, 0.3, (SYMBOLS, e)), "out": r.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p["w" + d] = r.normal(0, 1 / np.sqrt(e + h), (e + h, 4 * h))
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        # An inside tag follows only the begin or inside tag of its kind.
        self.barred = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.barred[:, inside] = -1e4
            self.barred[[inside - 1, inside], inside] = 0

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, t, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.empty((n, t, HIDDEN), np.float32)
        w, b = self.p["w" + d], self.p["c" + d]
        ahead = x @ w[:EMBED] + b
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = ahead[:, k] + h @ w[EMBED:]
            g = _sig(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * u
            s = np.tanh(c)
            h = o * s
            out[:, k] = h
            if keep is not None:
                keep.append((k, i, f, o, u, before, h_before, s))
        return out

    def emissions(self, sym: np.ndarray) -> np.ndarray:
        x = self.p["emb"][sym]
        both = np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags, and the margin of each tag's emission over outside."""
        e = self.emissions(sym)
        move = self.p["move"] + self.barred
        n, t, k = e.shape
        first = np.where(self.barred[0] < 0, -1e4, 0).astype(np.float32)
        score = e[:, 0] + first
        back = np.empty((n, t, k), np.int8)
        for s in range(1, t):
            step = score[:, :, None] + move[None]
            back[:, s] = step.argmax(axis=1)
            score = step.max(axis=1) + e[:, s]
        tags = np.empty((n, t), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for s in range(t - 1, 0, -1):
            tags[:, s - 1] = back[np.arange(n), s, tags[:, s]]
        return tags, np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]

    # -- training ----------------------------------------------------------
    def _crf(self, e: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, and its gradients by emissions and transitions, by forward-backward."""
        move = self.p["move"] + self.barred
        n, t, k = e.shape
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for s in range(1, t):
            a[:, s] = _lse(a[:, s - 1][:, :, None] + move, 1) + e[:, s]
        for s in range(t - 2, -1, -1):
            b[:, s] = _lse(move[None] + (e[:, s + 1] + b[:, s + 1])[:, None, :], 2)
        z = _lse(a[:, -1], 1)
        post = np.exp(a + b - z[:, None, None])
        pair = np.zeros((k, k), np.float32)
        for s in range(1, t):
            pair += np.exp(a[:, s - 1][:, :, None] + move + (e[:, s] + b[:, s])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
        path = np.take_along_axis(e, gold[:, :, None], 2).sum(axis=(1, 2)) + move[gold[:, :-1], gold[:, 1:]].sum(axis=1)
        np.put_along_axis(post, gold[:, :, None], np.take_along_axis(post, gold[:, :, None], 2) - 1, 2)
        return float((z - path).sum()), post, pair

    def gradient(self, sym: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x = self.p["emb"][sym]
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=2)
        loss, de, pair = self._crf(both @ self.p["out"] + self.p["bias"], gold)
        g = {"move": pair, "out": np.tensordot(both, de, ([0, 1], [0, 1])), "bias": de.sum(axis=(0, 1))}
        dboth, dx = de @ self.p["out"].T, np.zeros_like(x)
        for j, d in enumerate("fb"):
            w = self.p["w" + d]
            gw, gc = np.zeros_like(w), np.zeros_like(self.p["c" + d])
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for k, i, f, o, u, before, h_before, s in reversed(kept[d]):
                dh = dh + dboth[:, k, j * HIDDEN : (j + 1) * HIDDEN]
                dc = dc + dh * o * (1 - s * s)
                dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                gw[:EMBED] += x[:, k].T @ dz
                gw[EMBED:] += h_before.T @ dz
                gc += dz.sum(axis=0)
                dx[:, k] += dz @ w[:EMBED].T
                dh = dz @ w[EMBED:].T
                dc = dc * f
            g["w" + d], g["c" + d] = gw, gc
        emb = np.zeros_like(self.p["emb"])
        np.add.at(emb, sym.ravel(), dx.reshape(-1, EMBED))
        g["emb"] = emb
        return loss, g

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 12, batch: int = 32, rate: float = 0.015, seed: int = 3) -> Tagger:
        """Adam from labelled spans (kind, start, end) of texts of at most ``WINDOW`` characters."""
        sym = np.zeros((len(examples), WINDOW), np.int64)
        gold = np.zeros_like(sym)
        for k, (text, spans) in enumerate(examples):
            sym[k, : len(text)] = _symbols(text)
            for kind, a, b in spans:
                tag = 1 + 2 * KINDS.index(kind)
                gold[k, a:b] = tag + 1
                gold[k, a] = tag
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total = 0, epochs * -(-len(sym) // batch)
        for _ in range(epochs):
            order = r.permutation(len(sym))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                _, g = self.gradient(sym[pick], gold[pick])
                step += 1
                now = rate * (1 - step / (total + 1))
                for k in self.p:
                    d = np.clip(g[k] / len(pick), -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


# -- labelled spans --------------------------------------------------------
def maker(seed: int):
    """A source of made-up pieces: ``make(kind)`` gives a text that holds one, plain or disguised."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    parts = ["an", "er", "en", "th", "on", "re", "ti", "au", "sch", "que", "or", "la", "ie", "nd", "ö", "é", "ción"]
    word = lambda: "".join(pick(parts) for _ in range(int(r.integers(1, 4))))

    def card(plain: bool) -> str:
        body = digits(int(r.integers(12, 16)))
        d = next(c for c in "0123456789" if luhn(body + c))
        s, sep = body + d, pick(["", "", " ", "-"] if plain else [".", "/", "_", " - "])
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    def phone(plain: bool) -> str:
        a, b, c, country = digits(3), digits(3), digits(4), str(r.integers(1, 99))
        if plain:
            return pick([f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country}.{a}.{b}.{c}"])
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{country} {a} {b} {c}", f"{a}/{b}-{c}", f"00{country} ({a}) {b}-{c}"])

    def email(plain: bool) -> str:
        ascii_word = lambda: word().encode("ascii", "ignore").decode() or "an"
        local = ascii_word() + pick(["", "", ".", "_", digits(2)]) + pick(["", digits(2), ascii_word()])
        if local[-1] in "._":
            local += digits(2)
        host = [pick([ascii_word(), f"mail{digits(1)}.example"]), pick(["com", "org", "net", "de", "example", "com"])]
        if plain:
            return f"{local}@{'.'.join(host)}"
        at, dot = pick([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", " (dot) "), (" @ ", " . "), ("{at}", "{dot}"), ("[at]", "[dot]"), (" AT ", " DOT ")])
        return at.join([local, dot.join(".".join(host).split("."))])

    def ip(plain: bool) -> str:
        return pick(["."] if plain else ["[.]", "(.)", " . ", " dot ", "[dot]"]).join(str(x) for x in r.integers(0, 256, 4))

    kinds = {"email": email, "card": card, "phone": phone, "ip": ip}
    unlike = [
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: digits(int(r.integers(1, 7))), lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(2)}%", lambda: f"@{word()}", lambda: f"{digits(3)}.{digits(2)}", lambda: f"{word()}@{word()}",
        lambda: "".join(pick("0123456789abcdef") for _ in range(int(r.integers(16, 40)))), lambda: f"{digits(1)}/{digits(2)}/{digits(4)}", lambda: f'token = "{digits(4)}{word()}{digits(6)}"',
        lambda: f"at {word()}", lambda: f"{word()} at {word()} {word()}", lambda: f"dot {word()}", lambda: f"{word()} dot {word()}", lambda: f"BY {digits(1)}.{digits(1)}.", lambda: digits(16), lambda: f"({word()})",
    ]
    return r, pick, word, lambda kind, plain: kinds[kind](plain), lambda: pick(unlike)()


def labelled_examples(n: int = 2400, seed: int = 19) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up windows with labelled spans in plain and disguised spellings, and look-alikes without."""
    r, pick, word, make, unlike = maker(seed)
    out = []
    while len(out) < n:
        text, spans = "", []
        lead = pick(["", "", word() + " ", " ".join(word() for _ in range(3)) + " ", word() + ". "])
        text += lead
        for _ in range(int(r.integers(1, 3))):
            kind = pick([*KINDS, "email", "", "", ""])
            piece = make(kind, r.random() < 0.35) if kind else unlike()
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + pick([" ", ", ", ". ", "\n", "$$$ ", "### ", " | "]) + pick(["", word() + " "])
        text += " ".join(word() for _ in range(4))
        # Windows start and end anywhere, so spans are cut like the text.
        cut = int(r.integers(0, 12)) if not lead and r.random() < 0.5 else 0
        end = min(len(text), cut + WINDOW)
        out.append((text[cut:end], [(k, max(0, a - cut), min(b, end) - cut) for k, a, b in spans if b > cut and a < end]))
    return out


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger as fitted to :func:`labelled_examples`; the same in every process."""
    return Tagger().fit(labelled_examples())


# -- whole texts -----------------------------------------------------------
def _windows(text: str) -> list[int]:
    """Starts of the overlapping windows that can hold a part of an added span."""
    reach, last, out, done = MOST_CHARS + 2 * WINDOW, max(0, -(-(len(text) - WINDOW) // STRIDE)), [], 0
    for m in _HOT.finditer(text):
        for k in range(max(done, (m.start() - reach) // STRIDE), min(last, (m.start() + reach) // STRIDE) + 1):
            out.append(k * STRIDE)
            done = k + 1
    return out


def joined(spans: list[tuple[int, int, float, str, bool, bool]]) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, kind) with spans that meet at a window's edge made one.

    Takes spans that also say whether a window's edge cuts their start and
    their end. Of one kind, a span that is cut joins those it overlaps or
    touches; weights are means by character.
    """
    out = []
    for kind in KINDS:
        run: list = []
        for a, b, w, _, left, right in sorted(s for s in spans if s[3] == kind):
            if run and a <= run[1] and (left or run[4]):
                run[2] += w * (b - a)
                run[3] += b - a
                if b >= run[1]:
                    run[1], run[4] = b, right if b > run[1] else right and run[4]
            else:
                if run:
                    out.append((run[0], run[1], run[2] / run[3], kind))
                run = [a, b, w * (b - a), b - a, right]
        if run:
            out.append((run[0], run[1], run[2] / run[3], kind))
    return out


def reconcile(spans: list[tuple[int, int, float, str]]) -> list[tuple[int, int, float, str]]:
    """The spans of greatest total weight that do not overlap, over a whole text."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0], s[3]))
    best, ends = [(0.0, -1, None)], []
    for a, b, w, kind in spans:
        lo = int(np.searchsorted(ends, a, side="right"))
        take = best[lo][0] + w
        best.append((take, lo, (a, b, w, kind)) if take > best[-1][0] else (best[-1][0], len(best) - 1, None))
        ends.append(b)
    out, k = [], len(best) - 1
    while k > 0:
        _, before, s = best[k]
        if s:
            out.append(s)
        k = before
    return out[::-1]


def added_spans(texts: list[str], base: list[dict[str, list[tuple[int, int]]]], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """What the tagger adds to each text's base spans."""
    where = [(k, s) for k, t in enumerate(texts) for s in _windows(t)]
    found: list[list[tuple]] = [[] for _ in texts]
    known: dict[str, list[tuple[int, int, float, str]]] = {}
    pieces = [texts[k][s : s + WINDOW] for k, s in where]
    new = list(dict.fromkeys(pieces))
    for at in range(0, len(new), BATCH):
        part = new[at : at + BATCH]
        sym = np.zeros((len(part), WINDOW), np.int64)
        for k, t in enumerate(part):
            sym[k, : len(t)] = _symbols(t)
        tags, margins = tagger.decode(sym)
        for t, row, margin in zip(part, tags, margins, strict=True):
            known[t] = _decoded(row[: len(t)], margin)
    for (k, s), t in zip(where, pieces, strict=True):
        whole = len(texts[k])
        for a, b, w, kind in known[t]:
            found[k].append((s + a, s + b, w, kind, a == 0 and s > 0, b == len(t) and s + b < whole))
    out = []
    for text, spans, own in zip(texts, found, base, strict=True):
        taken = sorted(x for v in own.values() for x in v)
        ok = [s for s in joined(spans) if valid(s[3], text[s[0] : s[1]]) and not any(a < s[1] and s[0] < b for a, b in taken)]
        out.append([(kind, a, b) for a, b, _, kind in reconcile(ok)])
    return out


def _decoded(tags: np.ndarray, margin: np.ndarray) -> list[tuple[int, int, float, str]]:
    out, k = [], 0
    row = tags.tolist()
    while k < len(row):
        if row[k] % 2 == 1:
            a, inside = k, row[k] + 1
            k += 1
            while k < len(row) and row[k] == inside:
                k += 1
            out.append((a, k, float(max(0.01, margin[a:k].mean())), KINDS[(inside - 2) // 2]))
        else:
            k += 1
    return out


def find_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """(base spans, added spans) of each text; null counts as empty."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    return list(zip(base, added_spans(texts, base, tagger), strict=True))


def _joined(spans) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row for each row of ``docs``: counts and digest of base spans, all spans, added count.

    Offsets are code points, ends exclusive. Null and empty texts have no spans
    and the digest of an empty string. Null ids and repeated rows keep their
    rows; further columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def run(batches):
        for b in stage.slices(batches, "text"):
            found = find_spans(b.column(1).to_pylist(), shared.value)
            base = [[(k, x, y) for k, v in own.items() for x, y in v] for own, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([len(own[k]) for own, _ in found], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]),
                 pa.array([_joined([*s, *more]) for s, (_, more) in zip(base, found, strict=True)]),
                 pa.array([len(more) for _, more in found], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return stage.map_batches(rows, run, schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the name of its first kind."""
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= max(end, 0) or end < 0:
            out += [text[at:a], f"[{kind.upper()}]"]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data replaced by its kind and ``n_chars`` to match; other columns as they are.

    Null and empty texts, null ids and repeated rows stay as they are; columns
    pass through under any name; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in stage.slices(batches, "text"):
            texts = b.column(at).to_pylist()
            new = []
            for t, (own, more) in zip(texts, find_spans(texts, shared.value), strict=True):
                spans = [(k, x, y) for k, v in own.items() for x, y in v] + more
                new.append(redact(t, spans) if t and spans else t)
            cols = list(b.columns)
            cols[at] = pa.array(new, cols[at].type)
            if size is not None:
                old = cols[size].to_pylist()
                cols[size] = pa.array([o if n == t or n is None else len(n) for o, n, t in zip(old, new, texts, strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return stage.map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(stage.table(spark, sf_dir, "documents"))
