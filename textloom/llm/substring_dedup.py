"""Repeated passages across documents: MinHash banding of paragraphs, edit distance, components of removals."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, look_up, settle, small
from textloom.llm.components import connected_components
from textloom.llm.words import gram_hashes, word_hashes

#: Words of a shingle; share of a paragraph's words that two near copies have in common, by edit distance.
WORDS, NUM, DEN = 5, 4, 5
#: Words of a paragraph. Every run of WINDOW pairs of neighbouring words begins one, at its least hash, so any passage
#: of LENGTH + WINDOW - 1 = 51 words has a whole paragraph that is the same wherever the passage stands.
LENGTH, WINDOW = 32, 20
#: With what probability two paragraphs that differ by one word in the middle collide in a band.
RECALL = 0.97
#: Members up to which a band's pairs are made one by one; so are those of longer bands that make no more of them a member.
LIST = 32
#: Words of one batch of texts, and of a text that is a batch of its own.
BATCH_WORDS, LONG_TEXT = 2**17, 2**19
#: Questions for shared minima that a task answers, on average (16 bytes each).
TASK_QUESTIONS = 750_000


def bands_for(length: int = LENGTH, recall: float = RECALL, rows: int = 1) -> int:
    """The least number of bands of ``rows`` minima with which two paragraphs that differ by one word in the middle, so
    by WORDS shingles each, share a band with probability ``recall``."""
    shingles = length - WORDS + 1
    alike = max(shingles - WORDS, 1) / (shingles + WORDS)
    return math.ceil(math.log(1 - recall) / math.log(1 - alike**rows))


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def _sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours, by doubling."""
    out, width = h, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _batches(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, ends) of batches of texts: the words of all of them in a row, and where each text ends.
    Texts are hashed together, as a text alone has too few words to make up for the calls."""
    at, parts = 0, []
    for k, text in enumerate(texts):
        h = word_hashes(split_words(text))
        if parts and len(h) >= LONG_TEXT:
            yield at, np.concatenate(parts), np.cumsum([len(p) for p in parts])
            at, parts = k, []
        parts.append(h)
        if len(h) >= LONG_TEXT or len(parts) % 50 == 0 and sum(map(len, parts)) >= BATCH_WORDS:
            yield at, np.concatenate(parts), np.cumsum([len(p) for p in parts])
            at, parts = k + 1, []
    if parts:
        yield at, np.concatenate(parts), np.cumsum([len(p) for p in parts])


def starts_of(words: np.ndarray, length: int = LENGTH, window: int = WINDOW, ends: np.ndarray | None = None) -> np.ndarray:
    """First words of a text's paragraphs: the places of the least pair hash (the first of equals) of all windows, as far
    as a whole paragraph follows. Texts with fewer pairs than a window are one window. ``ends``: where each of several
    texts ends, if the words are those of several; places count from the first one's."""
    ends = np.array([len(words)]) if ends is None else ends
    sizes = np.diff(ends, prepend=0)
    if len(ends) > 1 and window >= length:
        return np.concatenate([starts_of(words[e - n : e], length, window) + e - n for e, n in zip(ends, sizes, strict=True)])
    if len(words) < length:
        return np.empty(0, np.int64)
    pairs = gram_hashes(words, 2)
    place = np.uint64(2 ** max(20, len(pairs).bit_length()) - 1)
    window = min(window, len(pairs))
    least = (_sliding_least((pairs & ~place) | np.arange(len(pairs), dtype=np.uint64), window) & place).astype(np.int64)
    if len(ends) > 1:  # windows and paragraphs lie in one text
        end = np.repeat(ends, sizes)
        own = np.flatnonzero(np.arange(len(least)) + window < end[: len(least)])
        least = least[own]
        if not len(least):
            return least
    first = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return first[first + length <= (end[first] if len(ends) > 1 else len(words))]


def _digests(h: np.ndarray, start: np.ndarray, bands: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Content key and bands of the paragraphs that begin at ``start``."""
    if not len(start):
        return np.empty(0, np.int64), np.empty((bands, 0), np.int64)
    grams = np.append(gram_hashes(h, WORDS), np.uint64(0))  # the last paragraph's end has to be a place
    edges = np.stack([start, start + length - WORDS + 1], 1).ravel()
    key = _mix(np.add.reduceat(_mix(grams, 1), edges)[::2], 2).view(np.int64)
    # neighbours overlap and so share minima; only paragraphs that begin with the same two words can be copies
    first = gram_hashes(h, 2)[start]
    minima = [_mix(np.minimum.reduceat(_mix(grams, 3 + b), edges)[::2] ^ first, 50 + b).view(np.int64) for b in range(bands)]
    return key, np.stack(minima) if minima else np.empty((0, len(start)), np.int64)


def paragraphs(text: str | None, bands: int, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, content key and bands (a row each: a minimum of the shingles, with the first two words) of a text's
    paragraphs. A-Z count as a-z."""
    h = word_hashes(split_words(text))
    start = starts_of(h, length, window)
    return start, *_digests(h, start, bands, length)


def _parts(docs: DataFrame, id_col: str, text_col: str, bands: int, length: int, window: int) -> DataFrame:
    """The paragraphs of a batch of texts as one row: part (a random number), n, and arrays of n as bytes: doc_id, start,
    key and m (one band after the other). As rows of their own they would cost many times as much to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, h, ends in _batches(t.as_py() for t in batch.column(1)):
                start = starts_of(h, length, window, ends)
                if not len(start):
                    continue
                key, minima = _digests(h, start, bands, length)
                text = np.searchsorted(ends, start, "right")
                place = (start - np.concatenate([[0], ends])[text]).astype(np.int32)
                row = [uuid.uuid4().int >> 65, len(start), ids[at + text].tobytes(), place.tobytes(), key.tobytes(), minima.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "n", "doc_id", "start", "key", "m"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "part long, n long, doc_id binary, start binary, key binary, m binary")


def _numbers(column: pa.Array, k: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), kind)


def _dealt(key: np.ndarray, m: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a part asks: (first place of each of its distinct keys, key number of each place, key number and band of each
    question, ends of the buckets). A question is a key's minimum in a band; they lie in the order of their buckets."""
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    bucket = ((m.reshape(-1, len(key))[:, first].view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).ravel()
    order = np.argsort(bucket, kind="stable")
    return first, number, order % len(first), order // len(first), np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, one after the other in ``data``, that end before its places ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


_QUESTION = np.dtype([("m", np.int64), ("key", np.int64)])


def _answers(m: np.ndarray, key: np.ndarray) -> np.ndarray:
    """1 where another question has the same m, and 2 more where one with the same m has another key."""
    if not len(m):
        return np.empty(0, np.uint8)
    order = np.argsort(m)
    m, key = m[order], key[order]
    same = np.concatenate([[False], m[1:] == m[:-1]])
    starts = np.flatnonzero(~same)
    sizes = np.diff(starts, append=len(m))
    other = np.logical_or.reduceat(same & np.concatenate([[False], key[1:] != key[:-1]]), starts)
    out = np.empty(len(m), np.uint8)
    out[order] = np.repeat((sizes > 1) + 2 * other, sizes).astype(np.uint8)
    return out


def _hits(parts: DataFrame, bands: int) -> DataFrame:
    """(doc_id, start, key, led, m0, m1, ...) of the paragraphs that share a band with another paragraph, m0, ... only
    where one with another key has it; led is the doc_id at a key's first place in a text, else null.

    A minimum is asked for once for each key of a part, so frequent keys do not gather, in a bucket of its hash; buckets
    grow in number with the table. The answer to a question takes a byte and goes back to the part. Only the distinct
    keys of one band lie in one task, 16 bytes each."""
    asked = parts.agg(F.sum("n")).first()[0] or 0
    tasks = asked * bands // TASK_QUESTIONS + 1
    buckets = 2 * tasks

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key, m = (_numbers(batch.column(c), k) for c in (1, 2))
                first, _, number, band, ends = _dealt(key, m, buckets)
                out = np.empty(len(number), _QUESTION)
                out["m"], out["key"] = m.reshape(bands, -1)[band, first[number]], key[first[number]]
                some = np.flatnonzero(np.diff(ends, prepend=0))
                part = pa.array(np.full(len(some), batch.column(0)[k].as_py()))
                yield pa.RecordBatch.from_arrays([part, pa.array(some.astype(np.int32)), _binaries(out, ends[some])], ["part", "bucket", "asked"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [(b.column(0), b.column(1), np.concatenate([_numbers(b.column(2), k, _QUESTION) for k in range(b.num_rows)]), np.array([len(x.as_buffer()) for x in b.column(2)]) // _QUESTION.itemsize) for b in batches if b.num_rows]
        if every:
            out, at = _answers(*(np.concatenate([q[c] for _, _, q, _ in every]) for c in ("m", "key"))), 0
            for part, bucket, q, sizes in every:
                yield pa.RecordBatch.from_arrays([part, bucket, _binaries(out[at : at + len(q)], np.cumsum(sizes))], ["part", "bucket", "said"])
                at += len(q)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (doc, start), (key, m) = (_numbers(batch.column(c), k, t) for c, t in ((0, np.int64), (1, np.int32))), (_numbers(batch.column(c), k) for c in (2, 3))
                first, number, asker, band, _ = _dealt(key, m, buckets)
                said = np.zeros((bands, len(first)), np.uint8)
                said[band, asker] = np.frombuffer(b"".join(x["said"] for x in sorted(batch.column(4)[k].as_py(), key=lambda x: x["bucket"])), np.uint8)
                hit = np.flatnonzero(((said.any(0)) | (np.bincount(number) > 1))[number])
                told = said[:, number[hit]] < 2
                key, doc, start, m = key[hit], doc[hit], start[hit], m.reshape(bands, -1)[:, hit]
                order = np.lexsort((start, doc, key))  # places of a key in a text follow one another
                late = np.zeros(len(hit), bool)
                late[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
                columns = [pa.array(doc), pa.array(start), pa.array(key), pa.array(doc, mask=late), *(pa.array(m[b], mask=told[b]) for b in range(bands))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "key", "led", *(f"m{b}" for b in range(bands))])

    questions = parts.select("part", "key", "m").mapInArrow(ask, "part long, bucket int, asked binary")
    said = settle(questions.repartition(tasks, "bucket").mapInArrow(answer, "part long, bucket int, said binary"), "answers")
    said_to = said.groupBy("part").agg(F.collect_list(F.struct("bucket", "said")).alias("said"))
    both = parts.drop("n").join(said_to.hint("merge"), "part").select("doc_id", "start", "key", "m", "said")
    out = settle(both.mapInArrow(pick, "doc_id long, start int, key long, led long, " + ", ".join(f"m{b} long" for b in range(bands))), "hits")
    discard(said)
    return out


def _once(hits: DataFrame, docs: DataFrame, id_col: str, limit: int | None) -> DataFrame:
    """Hits with one row for each (doc_id, start, key). Only ids that several rows have can repeat them."""
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    twice = settle(ids.where("n > 1").select("doc_id"), "twice")
    if twice.limit(1).count():
        rest = hits.join(small(twice, limit), "doc_id", "left_anti")
        again = hits.join(small(twice, limit), "doc_id", "left_semi").dropDuplicates(["doc_id", "start", "key"])
        least = F.min("start").over(Window.partitionBy("doc_id", "key"))
        again = again.withColumn("led", F.when(F.col("start") == least, F.col("doc_id")))
        hits, every = settle(rest.unionByName(again), "hits"), hits
        discard(every)
    discard(twice)
    return hits


def _contents(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, length: int, limit: int | None) -> DataFrame:
    """Settled (key, words): the words of each key as hashes, read at one place (doc_id, start) of each key. A text is
    read once, for all keys that are read in it."""
    asked = settle(places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "key")).alias("at")), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1)
            bounds, flat = spans.offsets.to_numpy(), spans.values
            starts, wanted = (flat.field(k).to_numpy() for k in ("start", "key"))
            for at, h, ends in _batches(t.as_py() for t in batch.column(0)):
                some = slice(bounds[at], bounds[at + len(ends)])
                text = np.repeat(np.arange(len(ends)), np.diff(bounds[at : at + len(ends) + 1]))
                place = starts[some] + np.concatenate([[0], ends])[text]
                inside = place + length <= ends[text]
                place, key = place[inside].astype(np.int64), wanted[some][inside]
                # a repeated id may have rows with other texts
                own = _digests(h, place, 0, length)[0] == key
                words = h[place[own][:, None] + np.arange(length)].view(np.int64).ravel()
                lists = pa.FixedSizeListArray.from_arrays(pa.array(words), length).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), lists], ["key", "words"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(small(asked, limit), "doc_id").select("text", "at")
    out = settle(rows.mapInArrow(run, "key long, words array<long>").dropDuplicates(["key"]), "contents")
    discard(asked)
    return out


def edit_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of x and y, word by word, all pairs of rows at once."""
    n, places = y.shape[1], np.arange(y.shape[1] + 1)
    row = np.broadcast_to(places, (len(x), n + 1)).astype(np.int16)
    for i in range(x.shape[1]):
        new = row + 1  # leave out a word of x
        np.minimum(new[:, 1:], row[:, :-1] + (y != x[:, i : i + 1]), out=new[:, 1:])
        new = np.minimum.accumulate(new - places, 1) + places  # leave out words of y
        row = new.astype(np.int16)
    return row[:, -1]


def _verified(pairs: DataFrame, contents: DataFrame, num: int, den: int) -> DataFrame:
    """Settled pairs (a, b) whose edit distance leaves num / den of the words alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, y = (part.column(k).flatten().to_numpy().reshape(part.num_rows, -1) for k in (2, 3))
                near = (x.shape[1] - edit_distances(x, y)) * den >= x.shape[1] * num
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(near)) for k in (0, 1)], ["a", "b"])

    side = lambda s: contents.select(F.col("key").alias(s), F.col("words").alias(f"w{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "wb")
    return settle(both.mapInArrow(run, "a long, b long"), "verified")


def _by_rare_words(bands: DataFrame, contents: DataFrame, length: int, num: int, den: int) -> DataFrame:
    """Lists (m, key, n) of a band's keys by the words that are rarest in it: any two keys of a band that an edit distance
    links are in one of its lists, for certain.

    An edit takes away one word, so linked keys have all but ``length * (den - num) / den`` of their words in common
    (equal words are told apart by number). In whatever order, then, they share one of the first of each, as many as
    edits are allowed and one. Words that one key alone holds need no list, but take their places in that order."""
    edits = length * (den - num) // den
    ordered = F.array_sort("words")
    tokens = F.transform(ordered, lambda w, i: F.xxhash64(w, i - F.array_position(ordered, w)))
    rows = settle(bands.select("m", "key", "n").join(contents, "key").select("m", "key", "n", F.explode(tokens).alias("t")), "tokens")
    held = rows.groupBy("m", "t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = rows.join(held, ["m", "t"]).groupBy("m", "key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts"))
    places = F.greatest(F.lit(edits + 1 - length) + F.size("ts"), F.lit(0))
    out = settle(lists.select("m", "key", "n", F.explode(F.slice("ts", F.lit(1), places)).alias("x")).select(F.xxhash64("m", "x.t").alias("m"), "key", "n"), "split")
    discard(rows)
    return out


def near_keys(index: DataFrame, contents: DataFrame, num: int = NUM, den: int = DEN, length: int = LENGTH) -> DataFrame:
    """(id, component) of all keys linked by an edit distance that leaves num / den of the words alike, among keys that
    share a band. ``index``: settled (m, key, n), a band's distinct keys and how often each occurs; ``contents``: settled
    (key, words), ``length`` words each.

    A band with n keys has n^2 pairs, so they are not made. The most frequent key stands for its band, and the others
    are verified against it, one row each. A band whose keys then lie in one component is done. Of the others, those of
    up to LIST keys, or with no more than LIST pairs a key between components, make all pairs between components. Longer
    ones are split by their rarest words, so that linked keys stay together in a list (see _by_rare_words), and the lists
    are treated alike; but all that are left then make all pairs between components. So no link within a band is lost.
    """
    components = index.sparkSession.createDataFrame([], "id long, component long")
    links: list[DataFrame] = []
    for last in (False, True):
        hubs = settle(index.groupBy("m").agg(F.max(F.struct("n", "key"))["key"].alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"), "hubs")
        stars = index.join(hubs, "m").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
        components = _joined(components, [*links, _verified(stars, contents, num, den)])
        placed = settle(index.join(components.withColumnRenamed("id", "key"), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component"), "placed")
        open_ = placed.groupBy("m", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("m").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.max(F.struct("k", "c"))["c"].alias("main"))
        open_ = open_.where("size * size > squares").select("m", "main", ((F.col("size") > LIST) & (F.col("size") * F.col("size") - F.col("squares") > 2 * LIST * F.col("size"))).alias("long"))
        every, placed = placed, settle(placed.join(open_, "m"), "open")
        discard(every)
        few = placed if last else placed.where("NOT long")
        side = lambda s: few.select("m", F.col("key").alias(s), F.col("c").alias(f"c{s}"), "main")  # noqa: B023, E731
        # of a pair between components, one at least is not in the main one
        pairs = side("a").where("ca <> main").drop("main").join(side("b"), "m").where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))))
        links = [_verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), contents, num, den)]
        long_ = placed.where("long")
        done = last or not long_.limit(1).count()
        if not done:
            index = _by_rare_words(long_, contents, length, num, den)
        discard(hubs, placed)
        if done:
            break
    if last:
        discard(index)
    return _joined(components, links)


def _joined(components: DataFrame, links: list[DataFrame]) -> DataFrame:
    """Components (id, component) after more links; only links between components go through the rounds. The tables
    given are deleted; every component has a row for itself, so all its ids follow it."""
    side = lambda s: components.select(F.col("id").alias(s), F.col("component").alias(f"c{s}"))
    every = links[0] if len(links) == 1 else links[0].union(links[1])
    between = every.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = connected_components(between)
    old = components.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    new = moved.join(components.select("id"), "id", "left_anti")
    out = settle(old.select("id", F.coalesce("to", "component").alias("component")).unionByName(new), "components")
    discard(components, *links, moved)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN,
                      length: int = LENGTH, window: int = WINDOW, recall: float = RECALL, limit: int | None = None) -> DataFrame:
    """Paragraphs that occur, alike or nearly so, in two or more documents: doc_id, start (word), n_words, cluster_id,
    keep_doc_id, keep_start, cluster_size and removed, one row per occurrence.

    Repeated passages may begin anywhere in a line, so paragraphs do too: they are runs of ``length`` words that begin
    at the least hash of two neighbouring words in a window of ``window`` pairs. Any passage of length + window - 1 words
    (51) thus has a whole paragraph in common with each of its copies, wherever they stand; paragraphs overlap, and
    about two in 21 words begin one. Each has a minimum of its 5-word shingles per band; the number of bands follows from ``recall``,
    for two paragraphs that differ by one word in the middle (3 bands of one minimum for 0.97). Paragraphs that share a
    band are joined and verified by edit distance: num / den of the words have to be alike (which holds wherever 0.8 of
    the 5-word shingles are the same). Verified links form components; of a component's occurrences the first (least
    doc_id, then start) is kept and the others are removed. See near_keys for bands that many paragraphs share, and
    _hits for how shared bands are found: the distinct keys of a band are put together, not its paragraphs.

    Paragraphs are distinct by 64-bit keys of their shingles. Shorter passages than 51 words are found where a paragraph
    happens to begin in time, passages of less than ``length`` words never; so are passages with edits, and there the
    more so the longer they are (README has the figures). Texts are read whole, however long.
    Null ids are left out; null and empty texts and those of less than ``length`` words have no paragraphs. Rows that
    repeat an id are one document: passages must occur in two different ids; equal rows of one (doc_id, start, key) count
    once. Empty table: no rows. Other columns are not read. ``limit`` replaces the bound of broadcasts, in rows.
    """
    bands = bands_for(length, recall)
    parts = settle(_parts(docs, id_col, text_col, bands, length, window), "paragraphs")
    hits = _hits(parts, bands)
    discard(parts)
    hits = _once(hits, docs, id_col, limit)
    minima = [f"m{b}" for b in range(bands)]
    keyed = hits.groupBy("key").agg(F.min("led").alias("doc_id"), F.min_by("start", "led").alias("start"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"), *(F.max(m).alias(m) for m in minima))
    keyed = keyed.select("key", F.struct("doc_id", "start").alias("first"), "last", "n", F.array_distinct(F.array_compact(F.array(*minima))).alias("ms"))
    keyed = settle(keyed.where("size(ms) > 0 OR first.doc_id < last"), "keys")
    index = settle(keyed.select(F.explode("ms").alias("m"), "key", "n"), "index")
    places = settle(keyed.where(F.size("ms") > 0).select("first.doc_id", "first.start", "key"), "places")
    contents = _contents(docs, places, id_col, text_col, length, limit)
    near = near_keys(index, contents, num, den, length)
    clustered = look_up(keyed.select("key", "first", "last", "n"), near.withColumnRenamed("id", "key"), ["key"], "left", limit)
    clustered = settle(clustered.select("key", "first", "last", "n", F.coalesce("component", "key").alias("cluster_id")), "clustered")
    clusters = clustered.groupBy("cluster_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("cluster_size")).where("first.doc_id < last")
    chosen = clustered.select("key", "cluster_id").join(clusters, "cluster_id")
    chosen = settle(chosen.select("key", "cluster_id", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").cast("long").alias("keep_start"), "cluster_size"), "chosen")
    discard(keyed, index, places, contents, near, clustered)
    out = look_up(hits.select("doc_id", F.col("start").cast("long").alias("start"), "key"), chosen, ["key"], "inner", limit)
    removed = ~((F.col("doc_id") == F.col("keep_doc_id")) & (F.col("start") == F.col("keep_start")))
    return out.select("doc_id", "start", F.lit(length).cast("long").alias("n_words"), "cluster_id", "keep_doc_id", "keep_start", "cluster_size", removed.alias("removed"))


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of removed paragraphs cut out of the texts; a text that loses none stays as it is. The
    spans of a document, which may overlap and are no more than it has paragraphs, are gathered and joined to it.

    Null ids, null texts and spans beyond a text's end leave the row as it is; rows that repeat an id lose the same
    spans each; repeated spans count once. Columns pass through, whatever their names."""
    spans = passages.where("removed").groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words")).alias("__spans")).withColumnRenamed("doc_id", "__id")
    rows = docs.join(spans, F.col(id_col) == F.col("__id"), "left").drop("__id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            texts, at = [], batch.schema.get_field_index(text_col)
            for text, spans in zip(batch.column(at).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if spans and text:
                    places = [m.span() for m in word.finditer(text)]
                    joined: list[list[int]] = []
                    for first, last in sorted((s["start"], min(s["start"] + s["n_words"], len(places))) for s in spans if s["start"] < len(places)):
                        if joined and first <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], last)
                        else:
                            joined.append([first, last])
                    for first, last in reversed(joined):
                        text = text[: places[first][0]] + text[places[last - 1][1] :]
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[:-1], batch.schema.names[:-1])

    return rows.mapInArrow(run, schema)
