"""Tokenisers and normalisers as column expressions. The rules differ on purpose; do not merge them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
LOWER_WORD = r"^[a-z]+(?:'[a-z]+)?$"
NUM, BOS, EOS = "<num>", "<s>", "</s>"
START, END = "<START>", "<END>"
SENTENCE_END = r"(?<=[.!?])\s+"
MIN_SENTENCE_WORDS = 4


def words(text: Column) -> Column:
    """Runs of ASCII letters, with one inner apostrophe; null gives null."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def separators(text: Column) -> Column:
    """What stands before, between and after the words: always one more than there are words."""
    return F.split(text, WORD, -1)


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def normalise(token: Column) -> Column:
    """Lower case; a word stays, a token with a digit becomes <num>, anything else null."""
    low = F.lower(token)
    return F.when(low.rlike(LOWER_WORD), low).when(low.rlike(r"\p{Nd}"), F.lit(NUM))


def normalise_tokens(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, normalise), lambda t: t.isNotNull())


def plain_tokens(tokens: Column) -> Column:
    """Like normalise_tokens, but tokens with digits are dropped."""
    return F.filter(F.transform(tokens, lambda t: F.lower(t)), lambda t: t.rlike(LOWER_WORD))


def live_token(token: Column) -> Column:
    """Lower case, letters, digits and apostrophes of any script only."""
    return F.regexp_replace(F.lower(token), r"[^\p{L}\p{N}']", "")


def committed(text: Column) -> Column:
    """Words closed by white space or one of .!?,;: (all if the text ends so, else all but the last)."""
    found = words(text)
    closed = text.rlike(r"[\s.!?,;:]$")
    return F.when(closed | (F.size(found) == 0), found).otherwise(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))))


def partial(text: Column) -> Column:
    """The word that is still being typed, or the empty string."""
    found = words(text)
    return F.when(text.rlike(r"[\s.!?,;:]$") | (F.size(found) == 0), F.lit("")).otherwise(F.element_at(found, -1))


def match_case(original: Column, replacement: Column) -> Column:
    """Gives the replacement the original's case. An original that equals the replacement only after lower-casing is
    rewritten too, so McDonald comes back as Mcdonald."""
    first = F.substring(original, 1, 1)
    letters = original.rlike("[a-zA-Z]")
    return (F.when(original == replacement, original)
            .when((original == F.upper(original)) & letters & (F.length(original) > 1), F.upper(replacement))
            .when((first == F.upper(first)) & first.rlike("[A-Z]"), F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1_000_000)))
            .otherwise(replacement))


def padded(tokens: Column, left: list[str], right: list[str]) -> Column:
    parts = [F.array(*[F.lit(x) for x in left])] if left else []
    return F.concat(*parts, tokens, *([F.array(*[F.lit(x) for x in right])] if right else []))


def ngrams(tokens: Column, n: int) -> Column:
    """The runs of n tokens as structs w1..wn; none if there are fewer. ``tokens`` should be a plain column: the token
    arrays shifted by 0..n-1 are zipped, so an expression would be evaluated once per shift."""
    most = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(tokens, F.lit(k + 1), most).alias(f"w{k + 1}") for k in range(n)])
