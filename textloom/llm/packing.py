"""Packing of documents into token sequences: sum-of-squares online packing with cutting at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textloom.llm.tokens import ID_BYTES, checksum, default_tokenizer, encoder
from textloom.llm.words import forget

CAPACITY = 4096
#: Windows that may be open at once; beyond it they are cut and filled up. Bounds a task's memory.
MAX_OPEN = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Puts pieces online into windows of ``capacity`` tokens.

    counts[h] is the number of open windows filled to level h. A piece of s tokens goes to the level h (0: a new
    window) for which the sum of counts[h]^2 over partially filled levels becomes least: leaving h changes it by
    1 - 2 counts[h], reaching h + s by 1 + 2 counts[h + s] (by nothing if the window is then full). Both are kept as
    arrays, so a step is one vector sum and its minimum; of equal levels the fullest wins. ``emit`` gets each window
    that is full, as a list of pieces (document, start, ids).
    """

    def __init__(self, capacity: int, emit, max_open: int = MAX_OPEN) -> None:
        self.capacity, self.emit, self.max_open = capacity, emit, max_open
        self.counts = np.zeros(capacity + 1, np.int64)
        self.leave = np.full(capacity + 1, 1 << 40, np.int64)
        self.leave[0] = 0
        self.reach = np.ones(capacity + 1, np.int64)
        self.reach[capacity] = 0
        self.levels: dict[int, list[list]] = {}
        self.n_open = 0

    def _count(self, level: int, by: int) -> None:
        n = self.counts[level] = self.counts[level] + by
        self.leave[level] = 1 - 2 * n if n else 1 << 40
        self.reach[level] = 1 + 2 * n

    def add(self, doc: tuple, ids: bytes) -> None:
        full = self.capacity * ID_BYTES
        at = 0
        while len(ids) - at >= full:
            self.emit([(doc, at // ID_BYTES, ids[at : at + full])])
            at += full
        if at < len(ids):
            self._place(doc, at // ID_BYTES, ids[at:])

    def _place(self, doc: tuple, start: int, ids: bytes) -> None:
        size = len(ids) // ID_BYTES
        change = self.leave[: self.capacity - size + 1] + self.reach[size:]
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        if level:
            window = self.levels[level].pop()
            self._count(level, -1)
            self.n_open -= 1
        else:
            window = []
        window.append((doc, start, ids))
        level += size
        if level == self.capacity:
            self.emit(window)
            return
        self.levels.setdefault(level, []).append(window)
        self._count(level, 1)
        self.n_open += 1
        if self.n_open > self.max_open:
            self._fill_up()

    def _fill_up(self) -> None:
        """Cuts pieces of the emptiest windows to fill the fullest; at most one window stays open."""
        windows = [w for level in sorted(self.levels) for w in self.levels[level]]
        for level in list(self.levels):
            if self.levels.pop(level):
                self._count(level, -int(self.counts[level]))
        self.n_open = 0
        sizes = [sum(len(p[2]) for p in w) // ID_BYTES for w in windows]
        low, high = 0, len(windows) - 1
        while low < high:
            gap = self.capacity - sizes[high]
            doc, start, ids = windows[low].pop()
            take = min(gap, len(ids) // ID_BYTES)
            cut = len(ids) - take * ID_BYTES
            if cut:
                windows[low].append((doc, start, ids[:cut]))
            windows[high].append((doc, start + cut // ID_BYTES, ids[cut:]))
            sizes[low] -= take
            sizes[high] += take
            low += not sizes[low]
            if sizes[high] == self.capacity:
                self.emit(windows[high])
                high -= 1
        if low == high:
            if sizes[low] == self.capacity:
                self.emit(windows[low])
            elif sizes[low]:
                self.levels[sizes[low]] = [windows[low]]
                self._count(sizes[low], 1)
                self.n_open = 1

    def finish(self) -> None:
        """Fills up; what is left in the last window is cut into sequences whose lengths are powers of two."""
        self._fill_up()
        rest = [p for windows in self.levels.values() for w in windows for p in w]
        left = sum(len(p[2]) for p in rest) // ID_BYTES
        while left:
            size = 1 << (left.bit_length() - 1)
            part, need = [], size * ID_BYTES
            while need:
                doc, start, ids = rest.pop(0)
                part.append((doc, start, ids[:need]))
                if len(ids) > need:
                    rest.insert(0, (doc, start + need // ID_BYTES, ids[need:]))
                need -= min(need, len(ids))
            self.emit(part)
            left -= size
        self.levels.clear()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY,
         end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, 16-bit little
    endian, ``with_ids``).

    A document is its text's ids and ``end_id``. Each partition packs its own documents as they stream by, so nothing
    is shuffled, and a task holds at most MAX_OPEN open windows. When it ends, the emptiest windows' pieces are cut to
    fill the others and the last one is cut at powers of two, so no sequence needs padding. A repeated task repeats its
    sequences: numbers come from the partition's and the order in it.

    Null or empty text: the end id alone. Null id: packed, with a null id. Repeated rows: packed as often. Texts of
    any length are cut at full windows. Empty table: no rows. Other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    schema = SCHEMA + (", ids binary" if with_ids else "")
    end = int(end_id).to_bytes(ID_BYTES, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        encode = encoder(path).encode
        first = TaskContext.get().partitionId() << 36
        done = 0
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal done
            offset = 0
            for (doc_id, tokens), start, ids in window:
                n = len(ids) // ID_BYTES
                rows.append((doc_id, start, n, checksum(np.frombuffer(ids, "<u2")), tokens, first + done, offset) + ((ids,) if with_ids else ()))
                offset += n
            done += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            names = [x.split()[0] for x in schema.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return out

        packer = Packer(capacity, emit)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    packer.add((doc_id, len(ids) // ID_BYTES), ids)
                if len(rows) > 4000:
                    yield flush()
        packer.finish()
        yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
