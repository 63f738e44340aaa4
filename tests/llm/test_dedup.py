"""Exact and near dedup, passages and components against brute force; edge cases."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

import textloom.llm.exact_dedup as exact
from textloom.llm import simjoin
from textloom.llm.components import connected_components
from textloom.llm.near_dedup import near_components, near_dedup, shingles
from textloom.llm.substring_dedup import bands_for, paragraphs, repeated_passages, without_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def frame(spark, texts, extra=()):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def text(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randint(0, vocabulary)}" for _ in range(n))


def edited(draw, words, edits):
    words = words.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randint(0, 10**6)}"
    return " ".join(words)


def brute_components(texts, words, num, den):
    def gram_set(t):
        w = lower(t).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])

    sets = {i: gram_set(t) for i, t in texts if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_exact_dedup_against_brute_force(spark, limit):
    draw = random.Random(1)
    base = [text(draw, draw.randint(0, 30)) for _ in range(30)]
    texts = [(i, draw.choice(base)) for i in range(120)] + [(500, None), (501, ""), (502, "É x"), (503, "é x"), (504, "É X"), (None, "lonely"), (505, " " * 9), (506, "y" * 100_000), (507, "Y" * 100_000)]
    got = exact.exact_dedup(frame(spark, texts), hash_all=True, limit=limit).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(texts)
    for r in got:
        ids = groups[lower(r["text"])]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
        assert r["full_hash"] == hashlib.sha256(lower(r["text"]).encode()).hexdigest()


def test_exact_dedup_hashes_survivors_only_and_keeps_columns(spark):
    df = frame(spark, [(1, "same"), (2, "SAME"), (3, "other")]).withColumn("Kept", F.lit("clash")).withColumn("count", F.lit(7))
    rows = {r["doc_id"]: r for r in exact.exact_dedup(df).collect()}
    assert rows[3]["full_hash"] is None and rows[1]["full_hash"] == rows[2]["full_hash"] and rows[1]["count"] == 7
    assert [rows[i]["kept"] for i in (1, 2, 3)] == [False, True, True]
    assert exact.exact_dedup(df.where("false")).count() == 0


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got[start] == min(seen)
    assert set(got) == set(near)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(seed):
    draw = random.Random(seed)
    texts, passage = [], text(draw, 40)
    for _ in range(12):
        base = text(draw, draw.choice([2, 5, 20, 80, 150]))
        texts += [base] + [edited(draw, base, draw.randint(0, 5)) for _ in range(draw.randint(0, 6))]
    crowd = text(draw, 60)
    texts += [edited(draw, crowd, draw.randint(0, 4)) for _ in range(70)]
    texts += [passage + " " + text(draw, draw.randint(5, 60)) for _ in range(40)]
    texts += ["", "  ", None, "one", "ONE", "two words", "a b c", "A b C"]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "num", "den", "size"), [(3, 85, 100, 32), (3, 85, 100, 4), (5, 4, 5, 4)])
def test_near_components_against_brute_force(spark, monkeypatch, words, num, den, size):
    monkeypatch.setattr(simjoin, "LIST", size)  # small: lists go by their centre
    texts = near_texts(words + size)
    want = brute_components(texts, words, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_components(frame(spark, texts), words, num, den).collect()}
    assert {i: v[:2] for i, v in got.items()} == want
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())
    assert len({c for _, c in want.values()}) < len(want) - 25


def test_near_dedup_keeps_rows_and_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = frame(spark, [(5, base), (3, base + " x"), (9, "other text here"), (None, base)]).withColumn("component_id", F.lit(1)).withColumn("n", F.lit(2))
    out = near_dedup(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "9", "None"]
    assert near_dedup(df.where("false")).count() == 0


def test_repeated_rows_of_one_document(spark):
    base = " ".join(f"w{i}" for i in range(30))
    got = near_components(frame(spark, [(1, base), (1, base), (2, base)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_shared_least_is_safe():
    assert 1 <= simjoin.shared_least(4, 5) < simjoin.shared_least(85, 100) < simjoin.INDEXED
    assert bands_for() == 3


@pytest.mark.parametrize("limit", [None, 0])
def test_rows_that_repeat_an_id_keep_all_their_links(spark, limit):
    draw = random.Random(3)
    a, b = text(draw, 80, 9000), text(draw, 80, 9000)
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, text(draw, 50, 9000)), (4, text(draw, 50, 9000)), (None, a)]
    for order in (rows, rows[::-1]):
        got = near_components(frame(spark, order), limit=limit).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
        assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_joins_beyond_the_broadcast_bound_give_the_same(spark):
    texts = near_texts(77)
    want = sorted(map(tuple, near_components(frame(spark, texts)).collect()), key=str)
    assert sorted(map(tuple, near_components(frame(spark, texts), limit=0).collect()), key=str) == want
    passages = sorted(map(tuple, repeated_passages(frame(spark, texts)).collect()))
    assert passages == sorted(map(tuple, repeated_passages(frame(spark, texts), limit=0).collect())) and passages


def test_work_in_a_crowd_grows_about_as_its_size(spark, monkeypatch):
    made = {}

    def settle(df, name, plain=simjoin.settle):
        out = plain(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simjoin, "settle", settle)
    counts = []
    for n in (400, 1600):
        draw = random.Random(1)
        base, texts = [f"w{i}" for i in range(100)], []
        for i in range(n):
            words = list(base)
            for p in draw.sample(range(100), draw.randint(1, 6)):
                words[p] = f"e{draw.randint(0, 10**6)}"
            texts.append((i, " ".join(words)))
        made.clear()
        got = {r["doc_id"]: r["component_id"] for r in near_components(frame(spark, texts), 3, 85, 100).collect()}
        if n == 400:
            assert got == {i: c for i, (_, c) in brute_components(texts, 3, 85, 100).items()}
        counts.append(dict(made))
    for name in ("merged", "shared", "mixed-items", "stand-ins"):
        assert counts[1][name] <= 4 * 1.5 * max(counts[0][name], 100), (name, counts)
    assert counts[1]["close"] <= 1600


def test_long_text_shingles_whole():
    long = " ".join(str(i) for i in range(200_000))
    assert len(shingles(long, 3)) == 199_998


def test_paragraphs_do_not_depend_on_place():
    draw = random.Random(2)
    passage = text(draw, 60, 5000)
    keys = [set(paragraphs(f"{text(draw, 90, 5000)} {passage} {text(draw, 40, 5000)}", 3)[1].tolist()) for _ in range(2)]
    assert keys[0] & keys[1]


def test_passages_are_found_and_clean_documents_left_alone(spark):
    draw = random.Random(6)
    shared = [text(draw, 70, 9000) for _ in range(5)]
    texts, hold = [], {}
    for i in range(60):
        parts = [text(draw, draw.randint(20, 120), 9000)]
        if i % 3 == 0:
            k = (i // 3) % 5
            parts += [shared[k] if i % 2 else edited(draw, shared[k], 1), text(draw, 30, 9000)]
            hold[i] = k
        texts.append((i, " ".join(parts) + "\nA short line that all share."))
    texts += [(100, None), (101, ""), (102, "few words"), (None, shared[0])]
    rows = repeated_passages(frame(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == set(hold)
    for r in rows:
        assert hold[r["doc_id"]] == hold[r["keep_doc_id"]]
    for k in range(5):
        firsts = {r["keep_doc_id"] for r in rows if hold[r["doc_id"]] == k and not r["removed"]}
        assert min(i for i in hold if hold[i] == k) in firsts
    cut = {r["doc_id"]: r["text"] for r in without_passages(frame(spark, texts), repeated_passages(frame(spark, texts))).collect()}
    late = [i for i in hold if any(r["doc_id"] == i and r["removed"] for r in rows)]
    assert all(len(cut[i].split()) < len(dict(texts)[i].split()) for i in late) and cut[1] == dict(texts)[1] and cut[100] is None


def test_near_paragraphs_link(spark):
    draw = random.Random(8)
    base = text(draw, 400, 9000)
    other = base.split()
    other[::60] = [f"z{i}" for i in range(len(other[::60]))]
    rows = repeated_passages(frame(spark, [(1, base), (2, " ".join(other))])).collect()
    assert sum(r["n_words"] for r in rows if r["doc_id"] == 2) > 200
    assert repeated_passages(frame(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_passages_with_edited_words_are_found(spark, edits):
    draw = random.Random(20 + edits)
    size, cases, texts = 51 * edits, 60, []
    for k in range(cases):
        passage = [f"p{draw.randint(0, 10**6)}" for _ in range(size)]
        other = list(passage)
        for e in range(edits):  # in the middle of equal pieces
            other[(2 * e + 1) * size // (2 * edits)] = f"e{draw.randint(0, 10**6)}"
        shingle = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        a, b = shingle(passage), shingle(other)
        assert 5 * len(a & b) >= 4 * len(a | b)
        for i, p in ((2 * k, passage), (2 * k + 1, other)):
            texts.append((i, f"{text(draw, draw.randint(30, 60), 10**6)} {' '.join(p)} {text(draw, draw.randint(30, 60), 10**6)}"))
    rows = repeated_passages(frame(spark, texts)).collect()
    assert all(r["keep_doc_id"] // 2 == r["doc_id"] // 2 for r in rows)
    found = {r["doc_id"] // 2 for r in rows if r["removed"]}
    print("recall", edits, len(found) / cases)
    assert len(found) >= 0.95 * cases
    assert not [r for r in rows if r["removed"] and r["doc_id"] % 2 == 0]
    assert sum(r["n_words"] for r in rows if r["removed"]) > 0.6 * size * cases


@pytest.mark.parametrize(("num", "den"), [(4, 5), (85, 100)])
def test_estimate_drops_links_at_the_threshold_as_rarely_as_stated(num, den):
    p, k = num / den, simjoin.SKETCH
    dropped = sum(math.comb(k, m) * p**m * (1 - p) ** (k - m) for m in range(k + 1) if m < simjoin.least_estimate(num, den) * k)
    assert 0 < dropped <= simjoin.MISS
