"""String expressions over names, tags and free text. Everything here is a native Column."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window, functions as F

_NOT_WORD = r"[^\p{L}\p{N}]+"


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters that decompose into an ASCII letter plus marks, and those letters."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if char == char.lower() and len(parts) > 1 and parts[0].isascii():
            accented.append(char)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def fold(text: Column) -> Column:
    """Lower-case and strip diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{M}+", "")


def tokens(text: Column) -> Column:
    """Folded words: maximal runs of letters and digits."""
    return F.filter(F.split(fold(text), _NOT_WORD), lambda w: w != "")


def fold_py(text: str) -> str:
    """The same folding for the few words of a query on the driver."""
    lowered = text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))
    return "".join(c for c in lowered if not unicodedata.category(c).startswith("M"))


def query_terms(query: str) -> list[tuple[str, bool]]:
    """Terms of a search text as (token, is_prefix). All are required and the last one is a prefix."""
    words = [w for w in re.split(r"[\W_]+", fold_py(query)) if w]
    return [(w, i == len(words) - 1) for i, w in enumerate(words)]


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; NULL when absent, empty, over 32 bytes or with a slash."""
    found = F.regexp_extract(name, r"\.([^./]+)\z", 1)
    return F.when((found != "") & (F.octet_length(found) <= 32), F.lower(found))


def normal_tag(tag: Column) -> Column:
    """Trimmed and lower-cased tag, NULL when empty or longer than 64 characters."""
    clean = F.lower(F.trim(tag))
    return F.when(F.length(clean).between(1, 64), clean)


def base_name(path: Column) -> Column:
    """Last non-empty path component."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda c: c != ""), F.lit(-1))


def natural_key(name: Column) -> Column:
    """Sort key that orders digit runs by value and ignores case and accents."""
    runs = F.regexp_extract_all(fold(name), F.lit(r"(\d+|\D+)"), F.lit(1))

    def encode(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)) \
            .otherwise(run)

    return F.array_join(F.transform(runs, encode), "")


#: A word as the index sees it, letters and digits with the marks that folding takes off them, and what follows it.
_WORD_AND_GAP = "([\\p{L}\\p{N}][\\p{L}\\p{N}\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]*)([^\\p{L}\\p{N}]*)"


def _term_of(word: Column, terms: list[tuple[str, bool]]) -> Column:
    """Number of the first term that a word meets, or -1."""
    folded, found = fold(word), F.lit(-1)
    for i, (term, prefix) in reversed(list(enumerate(terms))):
        found = F.when(F.startswith(folded, F.lit(term)) if prefix else folded == term, i).otherwise(found)
    return found


def snippets(texts: DataFrame, key: str, text: str, terms: list[tuple[str, bool]], size: int = 12,
             left: str = "«", right: str = "»", gap: str = "…") -> DataFrame:
    """``key, snippet``: of every text the fragment of ``size`` words around the densest match, hits marked, cut ends shown by ``gap``.

    A window of words starting at a hit scores 1000 for every different term in it and 1 for each further hit; the first best one is then
    centred on its hits. A text without a hit shows its beginning, one without words itself, NULL is NULL. ``key`` tells the rows apart.
    Only hits are windowed, so whole tables of long texts may be cut.
    """
    cut = texts.select(
        key, F.regexp_extract(text, r"\A[^\p{L}\p{N}]*", 0).alias("_lead"),
        *[F.regexp_extract_all(text, F.lit(_WORD_AND_GAP), F.lit(i)).alias(name) for i, name in ((1, "_words"), (2, "_gaps"))]) \
        .withColumn("_terms", F.transform("_words", lambda w: _term_of(w, terms)))
    hits = cut.select(key, F.posexplode("_terms").alias("_at", "_term")).filter("_term >= 0")
    ahead = Window.partitionBy(key).orderBy("_at").rangeBetween(0, size - 1)
    different = sum((F.max((F.col("_term") == i).cast("int")).over(ahead) for i in range(len(terms))), F.lit(0))
    scored = hits.select(key, "_at", F.max("_at").over(ahead).alias("_last"), different.alias("_different"), F.count(F.lit(1)).over(ahead).alias("_inside"))
    best = scored.groupBy(key).agg(F.max_by(F.struct("_at", "_last"), F.struct(F.col("_different") * 999 + F.col("_inside"), -F.col("_at"))).alias("_best"))

    slack = F.floor((size - (F.col("_best._last") + 1 - F.col("_best._at"))) / 2)
    centred = F.greatest(F.lit(0), F.least(F.col("_best._at") - slack, F.size("_words") - size)).cast("int")
    start = F.when(F.col("_best").isNull(), 0).otherwise(centred)
    ends = F.col("_start") + size >= F.size("_words")
    shown = [F.slice(c, F.col("_start") + 1, F.lit(size)) for c in ("_words", "_gaps", "_terms")]
    marked = F.zip_with(shown[0], shown[2], lambda w, t: F.when(t >= 0, F.concat(F.lit(left), w, F.lit(right))).otherwise(w))
    between = F.zip_with(shown[1], F.sequence(F.lit(1), F.size(shown[1])), lambda g, i: F.when(ends | (i < size), g).otherwise(F.lit(gap)))
    body = F.array_join(F.zip_with(marked, between, lambda w, g: F.concat(w, g)), "")
    opening = F.when(F.col("_start") > 0, F.lit(gap)).otherwise(F.col("_lead"))
    fragment = F.when(F.size("_words") > 0, F.concat(opening, body)).otherwise(F.col("_lead"))
    return cut.join(best, key, "left").withColumn("_start", start).select(key, fragment.alias("snippet"))
