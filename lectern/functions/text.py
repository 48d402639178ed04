"""Scalar text, date and vector functions as Column builders."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Turkish month names, long, short and without accents.
MONTHS = {
    "ocak": 1, "oca": 1, "şubat": 2, "subat": 2, "şub": 2, "sub": 2, "mart": 3, "mar": 3, "nisan": 4, "nis": 4, "mayıs": 5, "mayis": 5, "may": 5, "haziran": 6, "haz": 6,
    "temmuz": 7, "tem": 7, "ağustos": 8, "agustos": 8, "ağu": 8, "agu": 8, "eylül": 9, "eylul": 9, "eyl": 9, "ekim": 10, "eki": 10, "kasım": 11, "kasim": 11, "kas": 11, "aralık": 12, "aralik": 12, "ara": 12,
}

ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def lower_tr(c: Column) -> Column:
    """Lower case by Turkish rules: dotted and dotless i stay apart."""
    # Replacing searches bytes; translating would make a string of each character.
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def upper_tr(c: Column) -> Column:
    return F.upper(F.replace(F.replace(c, F.lit("i"), F.lit("İ")), F.lit("ı"), F.lit("I")))


def normalize_tr(c: Column) -> Column:
    """Turkish lower case without ASCII punctuation."""
    return F.regexp_replace(lower_tr(c), ASCII_PUNCTUATION, "")


def fold(c: Column) -> Column:
    """Lower case without Turkish accents, for word lists."""
    return F.lower(F.translate(c, "ıİIşŞçÇğĞüÜöÖ", "iiissccgguuoo"))


def folded(s: str) -> str:
    """:func:`fold` of a plain string."""
    return s.translate(str.maketrans("ıİIşŞçÇğĞüÜöÖ", "iiissccgguuoo")).lower()


def name_tokens(c: Column) -> Column:
    """Distinct words of a name, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(lower_tr(c), F.lit(r"(?U)\w+"), F.lit(0)))


def tokens(c: Column) -> Column:
    """Lower-cased words between white space, repeats included."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def iso_prefix(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 10), F.lit(""))


def iso_year(c: Column) -> Column:
    """The year of an ISO date, 0 if it has none."""
    return F.coalesce(F.substring(c, 1, 4).try_cast("int"), F.lit(0))


def exact_dates(c: Column) -> Column:
    """Sorted distinct ISO dates named in a text: ISO, numeric, or with a Turkish month."""
    text = lower_tr(c)
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])

    def joined(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    iso = F.transform(
        F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{1,2}-\d{1,2}\b"), F.lit(0)),
        lambda s: joined(*(F.element_at(F.split(s, "-"), k) for k in (1, 2, 3))),
    )
    numeric = F.transform(
        F.regexp_extract_all(text, F.lit(r"\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b"), F.lit(0)),
        lambda s: joined(*(F.element_at(F.split(s, "[./-]"), k) for k in (3, 2, 1))),
    )
    worded = F.transform(
        F.regexp_extract_all(text, F.lit(rf"(?U)\b\d{{1,2}}\s+(?:{names})\s+\d{{4}}\b"), F.lit(0)),
        lambda s: joined(F.element_at(F.split(s, r"\s+"), 3), F.element_at(months, F.element_at(F.split(s, r"\s+"), 2)).cast("string"), F.element_at(F.split(s, r"\s+"), 1)),
    )
    return F.array_sort(F.array_distinct(F.concat(iso, numeric, worded)))


def bare_years(c: Column) -> Column:
    """Sorted distinct years 1900 to 2100 that stand outside full dates."""
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    full = rf"(?U)\b\d{{4}}-\d{{1,2}}-\d{{1,2}}\b|\b\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}\b|\b\d{{1,2}}\s+(?:{names})\s+\d{{4}}\b"
    rest = F.regexp_replace(lower_tr(c), full, " ")
    found = F.transform(F.regexp_extract_all(rest, F.lit(r"\b(?:19\d{2}|20\d{2}|2100)\b"), F.lit(0)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(found))


def prefix_line(pairs: list[tuple[str, Column]]) -> Column:
    """``Label: value | Label: value`` of the values that are neither null nor empty, with a line end."""
    parts = [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in pairs]
    line = F.concat_ws(" | ", *parts)
    return F.when(line != "", F.concat(line, F.lit("\n"))).otherwise("")


def chunk_parts(c: Column) -> tuple[Column, Column]:
    """Document id and index of a chunk id ``<document>_<index>``; null if it has no index."""
    ok = c.rlike(r"^.+_\d+$")
    return F.when(ok, F.regexp_extract(c, r"^(.+)_(\d+)$", 1)), F.when(ok, F.regexp_extract(c, r"^(.+)_(\d+)$", 2).cast("int"))


def excerpt_overlap(excerpt: Column, text: Column) -> Column:
    """The part of an excerpt's words that occur anywhere in a text."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    ws = F.filter(F.split(squeeze(excerpt), " "), lambda w: w != "")
    hit = F.size(F.filter(ws, lambda w: F.contains(squeeze(text), w)))
    return F.when(F.size(ws) > 0, hit / F.size(ws)).otherwise(0.0)


def slug(c: Column, most: int = 50) -> Column:
    flat = fold(c)
    return F.substring(F.regexp_replace(F.regexp_replace(flat, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def _plain_letters() -> tuple[dict[str, str], dict[str, str]]:
    """Signs of the basic plane beyond ASCII that decompose to one ASCII sign, and those that decompose to several."""
    one, more = {}, {}
    for k in (*range(128, 0xD800), *range(0xE000, 0x10000)):
        plain = unicodedata.normalize("NFKD", chr(k)).encode("ascii", "ignore").decode()
        if plain:
            (one if len(plain) == 1 else more)[chr(k)] = plain
    return one, more


def ascii_slug(c: Column, words: int = 3) -> Column:
    """The first words of a text, decomposed to ASCII, what has none left out, with hyphens between."""
    one, more = _plain_letters()
    # Signs that become several are rare: only texts that hold one are walked through.
    whole = F.map_from_arrays(F.array(*[F.lit(k) for k in more]), F.array(*[F.lit(v) for v in more.values()]))
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(whole, x), x)), "")
    text = F.when(c.rlike("[" + "".join(more) + "]"), spread).otherwise(c)
    plain = F.regexp_replace(F.translate(text, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")
    flat = F.lower(F.regexp_replace(F.regexp_replace(plain, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.array_join(F.slice(F.split(flat, "-"), 1, words), "-")


def is_url(c: Column) -> Column:
    return c.rlike("^(?i)https?://")


def url_filename(c: Column) -> Column:
    """The last segment of a URL if it has a dot, else a hash with ``.bin``."""
    last = F.substring_index(F.regexp_replace(c, r"[?#].*$", ""), "/", -1)
    return F.when(F.contains(last, F.lit(".")), last).otherwise(F.concat(F.substring(F.sha2(c, 256), 1, 16), F.lit(".bin")))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector at length one; a zero vector as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def distance_score(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def distance_bar(d: Column) -> tuple[Column, Column]:
    """Percentage of closeness and its colour band."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / 2))
    return share * 100, F.when(share >= 0.65, "green").when(share >= 0.45, "yellow").otherwise("red")


def any_keyword(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(w)) for w in words], F.lit(False))
