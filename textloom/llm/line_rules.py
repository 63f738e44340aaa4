"""Line-first cleaning: rules drop lines, and documents that lose too much are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import without
from textloom.llm.words import gram_hashes, word_hashes

# Fixed values of the rules; all regular expressions mean the same to Python and to RE2.
#: A line that ends so is prose, and so is one with a sentence's end inside.
TERMINAL = r"""[.!?:;…。！？”"')\]}»]$"""
SENTENCE_INSIDE = r"""[.!?]["')]*[\x20\x09]"""
#: A word that ends in several marks.
MARKED_WORD = r"[#*$%&<>!?]{2,}$"
#: Words that separate menu entries.
SEPARATOR = r"^[|»›•·]$"
MENU = (r"(?i)^(home|menu|next|previous|prev|back|back to top|top|log ?in|sign ?in|sign ?up|register|search|share|share this|"
        r"contact|contact us|about|about us|read more|more|skip to (main )?content|site ?map|faq|help|print|comments?)[.!:>»›]*$")
BOILERPLATE = (r"(?i)(all rights reserved|licensed under|released under the|is licensed|terms of (use|service)|privacy policy|cookie policy|"
               r"(uses|accept|enable) (cookies|javascript)|lorem ipsum|click here|subscribe to our|sign up for our|powered by|"
               r"copyright (\(c\)|©|[0-9]{4})|^(©|\(c\)) ?[0-9]{4})")
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_MARKED_PERCENT, MAX_LOST_PERCENT = 20, 30, 30, 50
MIN_SEPARATORS, MAX_ENTRY_WORDS = 3, 4
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept", "clean_text")

_terminal, _inside, _marked, _separator, _menu, _boiler = map(re.compile, (TERMINAL, SENTENCE_INSIDE, MARKED_WORD, SEPARATOR, MENU, BOILERPLATE))
_spaces = re.compile(r"[\x20\x09-\x0D]+")
_any_separator, _any_marks = re.compile("[|»›•·]"), re.compile(r"[#*$%&<>!?]{2}")
#: Every boilerplate phrase has one of these; only texts that do have their lines tried for phrases.
BOILERPLATE_HINTS = ("reserved", "licensed", "released", "terms of", "policy", "cookies", "javascript", "lorem", "click", "subscribe", "sign up",
                     "powered", "copyright", "©", "(c)")


def failed_rule(line: str, n: int, phrases: bool = True) -> str | None:
    """The first rule a line with n words fails: navigation, boilerplate, punctuation or marks. Words are looked at one
    by one only where the line has a separator or a string of marks at all."""
    line = line.strip(SPACE)
    if n >= MIN_SEPARATORS and _any_separator.search(line):
        separators = sum(1 for w in _spaces.split(line) if _separator.search(w))
        if separators >= MIN_SEPARATORS and n - separators <= MAX_ENTRY_WORDS * (separators + 1):
            return "navigation"
    if n <= 5 and _menu.search(line):
        return "navigation"
    if phrases and _boiler.search(line):
        return "boilerplate"
    if not _terminal.search(line[-1:]) and not _inside.search(line):
        return "punctuation"
    if _any_marks.search(line) and 100 * sum(1 for w in _spaces.split(line) if _marked.search(w)) > MAX_MARKED_PERCENT * n:
        return "marks"
    return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    grams = gram_hashes(word_hashes(words), window)
    if len(grams) < 2:
        return 0
    _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[back] > 1)
    if not len(at):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def examine(text: str) -> tuple:
    """The values of RESULT for one text."""
    n_words = dup = lost = 0
    kept_lines, seen = [], set()
    low = text.lower()
    phrases = any(h in low for h in BOILERPLATE_HINTS)
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            kept_lines.append(line)
            continue
        n_words += n
        dup += line in seen
        seen.add(line)
        if failed_rule(line, n, phrases):
            lost += n
        else:
            kept_lines.append(line)
    repeat = repeated_words(text.encode("utf-8", "surrogatepass").split())
    base = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words
    kept = not base and 100 * lost <= MAX_LOST_PERCENT * n_words
    return (n_words, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeat, base, lost, kept,
            "\n".join(kept_lines) if lost else text)


def clean_lines(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept and clean_text.

    Each line with a word is tried on its own: menus (separators between short entries, menu words), boilerplate
    phrases, lines that neither end nor pause like prose, lines of words with strings of marks. Failing lines go;
    clean_text is the rest (the text itself if none fails). A document is rejected (kept false) if base_failed, or if
    more than MAX_LOST_PERCENT of its words stood in failing lines. Rows are examined where they lie: no shuffle.

    Null text: no words, rejected, clean_text empty. Empty text or white space: the same. Repeated rows: each alike.
    Lines of any length are read whole. Empty table: empty result. Input columns named like a result column are
    replaced; all others pass through.
    """
    base = without(docs, RESULT)
    names = RESULT if with_text else RESULT[:-1]
    kinds = ["long"] * 5 + ["boolean", "long", "boolean", "string"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + [f"{n} {k}" for n, k in zip(names, kinds, strict=False)])
    types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [examine(t or "") for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)][: len(names)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    return base.mapInArrow(run, schema)
