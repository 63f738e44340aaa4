"""One-character edits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LETTERS + "'"


def _cuts(word: Column, first: int, last: Column) -> Column:
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def _head(word: Column, n: Column) -> Column:
    return F.substring(word, F.lit(1), n)


def _tail(word: Column, at: Column) -> Column:
    return F.substring(word, at, F.length(word))


def deletes(word: Column) -> Column:
    """Distinct strings with one character less; none for the empty string."""
    return F.array_distinct(F.transform(_cuts(word, 1, F.length(word)), lambda i: F.concat(_head(word, i - 1), _tail(word, i + 1))))


def transposes(word: Column) -> Column:
    return F.transform(_cuts(word, 1, F.length(word) - 1), lambda i: F.concat(_head(word, i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), _tail(word, i + 2)))


def replaces(word: Column, alphabet: str = ALPHABET) -> Column:
    letters = F.array(*[F.lit(c) for c in alphabet])
    return F.flatten(F.transform(_cuts(word, 1, F.length(word)), lambda i: F.transform(letters, lambda c: F.concat(_head(word, i - 1), c, _tail(word, i + 1)))))


def inserts(word: Column, alphabet: str = ALPHABET) -> Column:
    letters = F.array(*[F.lit(c) for c in alphabet])
    return F.flatten(F.transform(_cuts(word, 0, F.length(word)), lambda i: F.transform(letters, lambda c: F.concat(_head(word, i), c, _tail(word, i + 1)))))


def edits(word: Column, alphabet: str = ALPHABET) -> Column:
    """Distinct strings within one delete, adjacent transpose, replace or insert; the word itself may be among them."""
    return F.array_distinct(F.concat(deletes(word), transposes(word), replaces(word, alphabet), inserts(word, alphabet)))


def single_edits(word: Column, alphabet: str = LETTERS) -> Column:
    """Edits without the word itself, sorted."""
    return F.array_sort(F.array_remove(edits(word, alphabet), word))


def within_one(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance (optimal string alignment) of at most one. Lengths are compared first."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
                       lambda i: F.concat(_head(a, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), _tail(a, i + 2)) == b)
    return (F.abs(F.length(a) - F.length(b)) <= 1) & ((F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & (F.length(a) >= 2) & swapped))


def strings_built(word: Column) -> tuple[Column, Column]:
    """How many strings enumerating and indexing build for a word."""
    n, k = F.length(word), len(ALPHABET)
    return n + (n - 1) + n * k + (n + 1) * k, n + 1


def common_prefix(a: Column, b: Column) -> Column:
    longest = F.least(F.length(a), F.length(b))
    ends = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(ends, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
