"""Classifiers and passages against plain definitions on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality as ql
from textloom.llm import toxicity as tx
from textloom.llm import substring_dedup as sd
from textloom.llm.substring_dedup import LENGTH, repeated_passages, split_words, starts_of
from textloom.llm.words import gram_hashes, word_hashes


def plain_ftrl(rows, labels, epochs, seed):
    """Follow the regularised leader, one slot at a time."""
    z, n = Counter(), Counter()
    heavier = min(max(labels.count(0) / labels.count(1), 1), tx.MAX_WEIGHT)

    def weight(slot):
        bound = 0 if slot == "bias" else tx.L1
        if abs(z[slot]) <= bound:
            return 0.0
        return -(z[slot] - math.copysign(bound, z[slot])) / ((tx.BETA + math.sqrt(n[slot])) / tx.ALPHA + tx.L2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            slots = [*rows[k], "bias"]
            w = {s: weight(s) for s in slots}
            g = (1 / (1 + math.exp(-sum(w.values()))) - labels[k]) * (heavier if labels[k] else 1)
            for s in slots:
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / tx.ALPHA * w[s]
                n[s] += g * g
    return {s: w for s in z if (w := weight(s))}


def test_toxicity_against_plain_ftrl(spark, monkeypatch):
    monkeypatch.setattr(tx, "L1", 2.0)
    draw = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(draw.choices(words, k=12) + (["Rude!"] if k % 5 == 0 else [])) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = tx.train_toxicity(docs, labels, F.col("doc_id") < 150)
    rows = [sorted(set(tx.features(t).tolist())) for t in texts]
    want = plain_ftrl(rows[:150], [int(k % 5 == 0) for k in range(150)], tx.EPOCHS, 3)
    bias = want.pop("bias")
    got = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    assert model[2] == pytest.approx(bias) and got.keys() == want.keys() and got
    assert all(got[s] == pytest.approx(w, rel=1e-5, abs=1e-6) for s, w in want.items())
    for r in tx.score_toxicity(docs, model).collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-bias - sum(want.get(s, 0) for s in rows[r["doc_id"]]))), abs=1e-5)


def test_quality_against_stacked_least_squares(spark):
    draw = random.Random(7)
    texts, ys = [], []
    for k in range(400):
        good = draw.random() < 0.5
        n = draw.randint(5, 60)
        texts.append(" ".join(draw.choice(["stream", "mountain", "Forest.", "quiet"] if good or draw.random() < 0.3 else ["|", "click", "BUY!!", "##", "12"]) for _ in range(n)))
        ys.append(int(good))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(ys)), "doc_id long, quality int")
    stats = ql.document_statistics(docs)
    model = ql.train_quality(stats, labels, F.lit(True))
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(ql.CALIBRATE_MOD)) == 0).alias("h")).collect()}
    x, y = np.array([ql.statistics(t) for t in texts]), np.array(ys, float)
    fit = np.array([not held[k] for k in range(400)])
    assert 200 < fit.sum() < 380
    mean, scale = x[fit].mean(0), np.sqrt(np.maximum(x[fit].var(0), 1e-12))
    random_ = np.random.default_rng(ql.SEED)
    turn = random_.normal(0, math.sqrt(2 * ql.GAMMA), (x.shape[1], ql.FEATURES))
    shift = random_.uniform(0, 2 * math.pi, ql.FEATURES)
    at = np.clip((x - mean) / scale, -5, 5)
    z = np.column_stack([np.ones(400), at, math.sqrt(2 / ql.FEATURES) * np.cos(at @ turn + shift)])
    # ridge as least squares with rows for the penalty
    penalty = np.diag([math.sqrt(1e-9), *[math.sqrt(ql.RIDGE)] * (z.shape[1] - 1)])
    beta = np.linalg.lstsq(np.vstack([z[fit], penalty]), np.append(y[fit], np.zeros(len(penalty))), rcond=None)[0]
    raw = z @ beta
    assert np.allclose(model.raw(x), raw, atol=1e-4)
    # isotonic regression by its definition: the greatest lower, least upper mean of runs
    edges = np.clip(((model.raw(x) - ql.LOW) / (ql.HIGH - ql.LOW) * ql.BINS).astype(int), 0, ql.BINS - 1)
    bins = sorted(set(edges[~fit]))
    w = np.array([np.sum(edges[~fit] == b) for b in bins], float)
    s = np.array([np.sum(y[~fit][edges[~fit] == b]) for b in bins])
    steps = [max(min(s[a : c + 1].sum() / w[a : c + 1].sum() for c in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    knots = [ql.LOW + (b + 0.5) * (ql.HIGH - ql.LOW) / ql.BINS for b in bins]
    want = np.clip(np.interp(model.raw(x), knots, steps), 0, 1)
    for r in ql.score_quality(stats, model).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_passages_against_all_pairs(spark):
    draw = random.Random(31)
    word = lambda: f"v{draw.randint(0, 4000)}"
    shared = [[word() for _ in range(draw.randint(55, 110))] for _ in range(6)]
    texts = []
    for i in range(44):
        body = [word() for _ in range(draw.randint(10, 60))]
        if i % 2 == 0:
            middle = list(shared[i // 2 % 6])
            for _ in range(draw.choice([0, 0, 1, 2])):
                middle[draw.randrange(len(middle))] = word()
            body = body + middle + [word() for _ in range(draw.randint(0, 40))]
        texts.append((i, " ".join(body)))
    rows = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    spans = [(i, int(at), split_words(t)[at : at + LENGTH]) for i, t in texts for at in starts_of(word_hashes(split_words(t)))]
    root = list(range(len(spans)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    counts = [Counter(w) for _, _, w in spans]
    for a in range(len(spans)):
        for b in range(a):
            # an edit distance of 6 or less leaves 26 words in common
            if (counts[a] & counts[b]).total() >= 26 and 5 * (LENGTH - edits(spans[a][2], spans[b][2])) >= 4 * LENGTH:
                root[find(a)] = find(b)
    where = {(i, at): find(k) for k, (i, at, _) in enumerate(spans)}
    docs_of: dict = {}
    for (i, _), c in where.items():
        docs_of.setdefault(c, set()).add(i)
    # what is returned is right: a cluster lies within one component of the definition
    for cluster in {r["cluster_id"] for r in rows}:
        assert len({where[r["doc_id"], r["start"]] for r in rows if r["cluster_id"] == cluster}) == 1
    # and nearly everything is returned
    linked = {(i, at) for (i, at), c in where.items() if len(docs_of[c]) > 1}
    got = {(r["doc_id"], r["start"]) for r in rows}
    assert got <= linked
    exact = Counter(tuple(w) for w in {(i, tuple(w)) for i, _, w in spans} for w in [w[1]])
    assert {(i, at) for i, at, w in spans if exact[tuple(w)] > 1} <= got
    print("recall of all pairs", len(got), len(linked))
    assert len({i for i, _ in got}) >= 0.9 * len({i for i, _ in linked}) and len(got) >= 0.8 * len(linked)


def test_links_of_a_long_band_are_all_found(spark):
    """200 texts share one band; each is within 6 edits of one other, with which it has no further shingle in common."""
    draw = random.Random(8)
    word = lambda n: f"v{draw.randint(0, n)}"

    def opening():
        while True:
            five = [word(10**6).encode() for _ in range(5)]
            h = word_hashes(five)
            if gram_hashes(h, 2)[0] < 2**64 // 2000 and sd._mix(gram_hashes(h, 5), 3)[0] < 2**64 // 1000:
                return [w.decode() for w in five]

    first, texts, shared = opening(), [], set()
    while len(texts) < 200:
        rest = [word(60) for _ in range(27)]
        copy = list(rest)
        for place in range(2, 27, 4)[: draw.choice([5, 6])]:
            copy[place] = "x" + word(10**6)
        found = [sd.paragraphs(" ".join(t), 3) for t in (first + rest, first + copy)]
        if all(start.tolist() == [0] for start, _, _ in found) and len(band := shared | {int(m[0, 0]) for _, _, m in found}) == 1:
            texts, shared = [*texts, first + rest, first + copy], band
    plain = [" ".join(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * (LENGTH - edits(texts[a], texts[b])) >= 4 * LENGTH:
                root = [root[b] if r == root[a] else r for r in root]
    rows = repeated_passages(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["cluster_id"], set()).add(r["doc_id"])
    want: dict = {}
    for k, r in enumerate(root):
        want.setdefault(r, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_texts_hashed_together_or_alone(spark, monkeypatch):
    """Paragraphs of many texts in a batch are those of each text alone, wherever batches end."""
    monkeypatch.setattr(sd, "BATCH_WORDS", 3000)
    monkeypatch.setattr(sd, "LONG_TEXT", 2500)
    draw = random.Random(9)
    texts = [None, "", "one"] + [" ".join(f"v{draw.randint(0, 900)}" for _ in range(draw.choice([1, 31, 32, 33, 52, 200, 3000]))) for _ in range(150)] + [""]
    for length, window in ((32, 20), (32, 40), (6, 3)):
        got = []
        for at, h, ends in sd._batches(texts):
            start = starts_of(h, length, window, ends)
            key, minima = sd._digests(h, start, 2, length)
            text = np.searchsorted(ends, start, "right")
            got += zip(at + text, start - np.concatenate([[0], ends])[text], key, *minima, strict=True)
        want = [(k, *x) for k, t in enumerate(texts) for s, key, m in [sd.paragraphs(t, 2, length, window)] for x in zip(s, key, *m, strict=True)]
        assert got == want and len({k for k, *_ in got}) > 50


def test_paragraphs_without_a_like_are_never_rows(spark, monkeypatch):
    """Only paragraphs that share a band become rows; which ones is found exactly, however questions are dealt."""
    made = {}

    def settle(df, name, plain=sd.settle):
        out = plain(df, name)
        made[name] = max(made.get(name, 0), out.count())
        if name == "hits":
            made["rows"] = [tuple(r) for r in out.collect()]
        return out

    monkeypatch.setattr(sd, "settle", settle)
    monkeypatch.setattr(sd, "TASK_QUESTIONS", 2000, raising=False)
    monkeypatch.setattr(sd, "BATCH_WORDS", 5000)
    draw = random.Random(12)
    word = lambda: f"v{draw.randint(0, 10**6)}"
    shared = [word() for _ in range(60)]
    texts = [(i, " ".join([word() for _ in range(300)] + (shared if i % 20 == 0 else []) + [word() for _ in range(20)])) for i in range(120)]
    texts += [(0, texts[0][1]), (20, texts[40][1])]  # equal rows of an id, and an id with two texts
    rows = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    every = [(i, int(s), int(k), tuple(m)) for i, t in texts for s, k, m in zip(*(lambda p: (p[0], p[1], p[2].T.tolist()))(sd.paragraphs(t, 3)), strict=True)]
    keys = {}
    for _, _, k, ms in every:
        for m in ms:
            keys.setdefault(m, Counter())[k] += 1
    want = {x for x in every if any(keys[m].total() > 1 for m in x[3])}
    assert {(r[0], r[1], r[2]) for r in made["rows"]} == {x[:3] for x in want} and len(made["rows"]) == len(want)
    assert {r[2]: tuple(r[4:]) for r in made["rows"]} == {k: tuple(m if len(keys[m]) > 1 else None for m in ms) for _, _, k, ms in want}
    assert {r["doc_id"] for r in rows} == set(range(0, 120, 20)) and 10 * len(want) < len(every)
    made.pop("rows")
    assert max(n for name, n in made.items() if name not in ("answers", "twice")) <= 2 * len(want), made  # a repeated row's twice


def test_an_id_of_several_rows_counts_a_place_once(spark):
    draw = random.Random(13)
    word = lambda: f"v{draw.randint(0, 10**6)}"
    passage = " ".join(word() for _ in range(70))
    other = " ".join(word() for _ in range(90))
    texts = [(1, passage), (1, passage), (2, other + " " + passage), (2, passage + " " + other), (3, passage), (4, other)]
    for limit in (None, 0):
        rows = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string"), limit=limit).collect()
        assert len({(r["doc_id"], r["start"]) for r in rows}) == len(rows)
        for c in {r["cluster_id"] for r in rows}:
            mine = [r for r in rows if r["cluster_id"] == c]
            assert {r["cluster_size"] for r in mine} == {len(mine)}
            assert {(r["keep_doc_id"], r["keep_start"]) for r in mine} == {min((r["doc_id"], r["start"]) for r in mine)}
