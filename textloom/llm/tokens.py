"""Token ids by the tokenizers library, with a bounded cache of the ids of white-space-separated chunks."""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np

#: Chunks in one generation of the cache; at most two generations are held, about 100 MB a worker.
GENERATION = 200_000
#: Texts with one of these are encoded whole: a special token's start, letters whose lower case depends on their
#: neighbours, and control characters that Python counts as white space but the tokenizer does not.
WHOLE = ("<|", "Σ", "İ", "\x1c", "\x1d", "\x1e", "\x1f")
#: Ids of the vocabularies used here fit 16 bits.
ID_BYTES = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A run of letters with ASCII marks after it; the marks make one piece. Apostrophes may start a piece of their own.
STEM_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins for bytes: printable Latin-1 characters stand for themselves, the others for
    characters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) if b in own else chr(256 + sum(x not in own for x in range(b))) for b in range(256)}


class _Known(dict):
    """Ids of chunks; a chunk asked for the first time is encoded."""

    def __init__(self, tokenizer, older: dict[str, bytes]) -> None:
        self.tokenizer, self.older = tokenizer, older
        self.word = tokenizer.model.tokenize
        self.letters = _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if chunk.isalpha():
                piece = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
                ids = struct.pack(f"<{len(t := self.word(piece))}H", *[x.id for x in t])
            elif m := STEM_AND_MARKS.fullmatch(chunk):
                ids = self[m[1]] + self[m[2]]
            else:
                ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()
        self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts to bytes of little-endian 16-bit ids.

    The tokenizer's pre-tokenizer drops white space and never joins what it separates, so a text's ids are the ids of
    its chunks put together, and a chunk's ids are kept for the next text. A chunk of letters is one piece and goes
    straight to the library's model. Texts for which that might not hold (not in NFC, or with one of WHOLE) are encoded
    whole by the library. Tests compare both ways.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("the vocabulary does not fit 16-bit ids")
        self.known = _Known(self.tokenizer, {})

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in WHOLE) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if len(self.known) > GENERATION:
            self.known.older = {}
            self.known = _Known(self.tokenizer, self.known)
        return b"".join(map(self.known.__getitem__, text.lower().split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def checksum(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
