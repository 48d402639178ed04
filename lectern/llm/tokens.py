"""Token ids of whole texts through the ``tokenizers`` library, with a bounded cache."""

from __future__ import annotations

import json
import os
import re
from array import array

#: Entries of a worker's cache, and bytes of the longest word that stays in it;
#: when it is full it becomes the older of two generations, so memory is bounded
#: and frequent words stay.
CACHE_ENTRIES = 450_000
CACHED_BYTES = 64

_TRAILING = re.compile(rb"(?<=[a-z])(?=[.,][ \n])")
#: A run of letters and the ASCII marks that follow it are separate words to
#: any splitter that sets letters apart; the apostrophe is left out because of
#: contractions.
_STEM = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)")
#: Words that the normalizer leaves as they are: lower case, composed.
_SETTLED = re.compile("[a-zß-öø-ÿ]+")


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordEncoder:
    """``encode_many(texts)`` gives the library's ids as little-endian uint32 bytes.

    Where the tokenizer drops white space and never merges across it, a text's
    ids are those of its white-space separated chunks in turn, so the library
    encodes each distinct chunk once. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        with open(path) as f:
            config = json.load(f)
        self.by_chunk = self._drops_space(config)
        shown = {b: c for c, b in byte_symbols().items()}
        self.stand_in = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}

    @staticmethod
    def _drops_space(config: dict) -> bool:
        pre = config.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        first, last = steps[0], steps[-1]
        pattern = str(first.get("pattern", {}).get("Regex", ""))
        special = config.get("added_tokens", [])
        return (
            first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and first.get("invert") is True
            and last.get("type") == "ByteLevel"
            and last.get("use_regex") is False
            and {"type": "Lowercase"} in (config.get("normalizer") or {}).get("normalizers", [])
            and r"[\p{L}]+" in pattern
            and r"[^\s\p{L}\p{N}]+" in pattern
            and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in special)
        )

    def _library(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in out]

    def _learn(self, chunks: list[bytes]) -> None:
        cache, older, other = self.cache, self.older, {}
        split, long, tokenize, settled = [], [], self.model.tokenize, _SETTLED.fullmatch

        def one(key: bytes, word: str) -> None:
            if key in cache or key in other:
                return
            if key in older:
                cache[key] = older[key]
            elif settled(word):
                shown = word if word.isascii() else word.translate(self.stand_in)
                cache[key] = array("I", [t.id for t in tokenize(shown)]).tobytes()
            else:
                other[key] = word

        for c in chunks:
            s = c.decode()
            m = None if c in cache or c in older or settled(s) else _STEM.fullmatch(s)
            if m:
                head, tail = m[1].encode(), m[2].encode()
                one(head, m[1])
                one(tail, m[2])
                split.append((c, head, tail))
                long += [x for x in (head, tail) if len(x) > CACHED_BYTES]
            else:
                one(c, s)
        if other:
            cache.update(zip(other, self._library(list(other.values())), strict=True))
        for c, head, tail in split:
            cache[c] = cache[head] + cache[tail]
        for c in long:
            cache.pop(c, None)

    @staticmethod
    def _chunks(text: bytes) -> list[bytes]:
        """White-space separated chunks, brought to fewer distinct ones.

        The tokenizer lower-cases by itself, but for its special strings; a
        mark between a letter and white space is a word of its own.
        """
        if b"<|" not in text:
            text = text.lower()
        return _TRAILING.sub(b" ", text).split()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as uint32 bytes; a null text counts as empty."""
        if not self.by_chunk:
            return self._library([t or "" for t in texts])
        if len(self.cache) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        cache, rows, missing = self.cache, [], []
        for t in texts:
            chunks = self._chunks(t.encode()) if t else []
            ids = list(map(cache.get, chunks))
            gaps = [(i, chunks[i]) for i, v in enumerate(ids) if v is None] if None in ids else []
            missing += [c for _, c in gaps]
            rows.append((ids, gaps))
        if missing:
            self._learn(missing)
        out = []
        for ids, gaps in rows:
            for i, c in gaps:
                ids[i] = cache[c]
            out.append(b"".join(ids))
        for c in missing:
            if len(c) > CACHED_BYTES:
                cache.pop(c, None)
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and path."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
