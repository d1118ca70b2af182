"""Text as columns: tokens, chunks and relevance, all of it built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though body may use it in lambdas and several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """ASCII words, lower-cased; null text gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), 0), lambda x: F.lower(x))


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def sentence_chunks(text: Column) -> Column:
    """Pieces ending in . ! or ?, trimmed; blank ones are dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def sliding_chunks(text: Column, size: int = 120, overlap: int = 30) -> Column:
    """Windows of size words, each size - overlap words after the last, until one reaches the end; empty for no words."""
    size = max(1, size)
    step = max(1, size - max(0, min(overlap, size - 1)))

    def cut(w: Column) -> Column:
        last = F.when(F.size(w) <= size, F.lit(0)).otherwise(F.ceil((F.size(w) - size) / F.lit(step)).cast("int"))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(text), cut)


def chunks(text: Column, strategy: str = "sentence", size: int = 120, overlap: int = 30) -> Column:
    return sliding_chunks(text, size, overlap) if strategy == "sliding" else sentence_chunks(text)


def chunk_score(chunk: Column, query: str) -> Column:
    """Relevance of a chunk: density and rarity of the query's tokens, a bonus for the whole phrase, damped by length, to 6 digits."""
    import re

    q = [t.lower() for t in re.findall("[A-Za-z0-9_]+", query)]
    if not q:
        return F.lit(0.0)
    bonus = F.when(F.contains(F.lower(chunk), F.lit(query.lower())), 2.0).otherwise(0.0)

    def scored(k: Column) -> Column:
        n, u = F.size(k).cast("double"), F.size(F.array_distinct(k)).cast("double")

        def part(t: str) -> Column:
            c = F.size(F.filter(k, lambda x: x == t)).cast("double")
            return c / n * 4.0 + c / u

        total = reduce(lambda a, b: a + b, [part(t) for t in q])
        score = F.round((total + bonus) * (1.0 + 1.0 / (1.0 + F.ln(F.greatest(F.lit(2.0), n)))), 6)
        return F.when(n > 0, score).otherwise(0.0)

    return let(tokens(chunk), scored)


def collapsed(text: Column, max_length: int | None = None) -> Column:
    """The text lower-cased with white space collapsed, or its first max_length characters."""
    t = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return t if max_length is None else F.substring(t, 1, max_length)


def ngrams(text: Column, width: int = 4, max_length: int | None = None) -> Column:
    """Runs of width characters of the text lower-cased with white space collapsed, or of its first max_length characters; a shorter text is its own run."""
    t = collapsed(text, max_length)

    def cut(c: Column) -> Column:  # characters as an array: a place in it is found at once, in a string by counting
        whole = F.array(F.array_join(c, ""))
        return F.when(F.size(c) < width, whole).otherwise(F.transform(F.sequence(F.lit(0), F.size(c) - width), lambda i: F.concat(*[F.get(c, i + k) for k in range(width)])))

    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(let(F.filter(F.split(t, ""), lambda x: x != ""), cut))


def reading_minutes(text: Column, per_minute: int = 220) -> Column:
    """Whole minutes, halves to even, at least 1; 0 for no words."""
    n = F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), 0))
    return F.when(n > 0, F.greatest(F.lit(1), F.bround(n / F.lit(per_minute)).cast("int"))).otherwise(0)


def phones(text: Column) -> Column:
    """Distinct phone numbers as their digits with a leading +, where there are at least 7 digits."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\+?\d[\d\s\x1c-\x1f().-]{6,}\d"), 0)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"(?U)[^\d+]", "")), lambda x: F.length(F.replace(x, F.lit("+"), F.lit(""))) >= 7))
