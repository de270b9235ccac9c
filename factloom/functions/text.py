"""Trigram similarity of short texts, with the padding and set rules of the well-known SQL extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigram_list(text: Column) -> Column:
    """Trigrams of each word in order: lower case, two blanks before a word and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.flatten(grams)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    return F.array_distinct(trigram_list(text))


def set_similarity(left: Column, right: Column) -> Column:
    """Shared over united elements of two arrays without repeats; 0 where both are empty."""
    return _bound(F.size(F.array_intersect(left, right)), lambda shared: F.coalesce(
        F.try_divide(shared, F.size(left) + F.size(right) - shared), F.lit(0.0)))


def similarity(a: Column, b: Column) -> Column:
    return _bound(trigrams(a), lambda x: _bound(trigrams(b), lambda y: set_similarity(x, y)))


def _bound(value: Column, body) -> Column:
    """`body` of a value computed once: a lambda variable, where an expression would be repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def extent_similarity(wanted: Column, ordered: Column) -> Column:
    """Best set similarity of `wanted` with any contiguous extent of the ordered trigrams.

    A best extent starts and ends on a wanted trigram, so only those positions are tried.
    """
    def best(w: Column, o: Column) -> Column:
        positions = F.filter(F.sequence(F.lit(1), F.size(o)), lambda i: F.array_contains(w, F.element_at(o, i)))
        return _bound(positions, lambda p: F.coalesce(F.array_max(F.transform(p, lambda s: F.array_max(F.transform(
            F.filter(p, lambda t: t >= s),
            lambda t: set_similarity(w, F.array_distinct(F.slice(o, s, t - s + 1))))))), F.lit(0.0)))
    return F.when((F.size(ordered) == 0) | (F.size(wanted) == 0), F.lit(0.0)).otherwise(
        _bound(wanted, lambda w: _bound(ordered, lambda o: best(w, o))))


def word_similarity(a: Column, b: Column) -> Column:
    """How well `a` matches the best stretch of `b`."""
    return extent_similarity(trigrams(a), trigram_list(b))
