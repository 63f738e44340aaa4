"""Encoder, packing, token store and classifiers: exact round trips and held-out accuracy."""

import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import queries as q
from textloom.llm.packing import Packer, pack
from textloom.llm.quality import document_statistics, isotonic, score_quality, train_quality
from textloom.llm.token_store import StoreReader, read_store, write_store
from textloom.llm.tokens import default_tokenizer, encoder
from textloom.llm.toxicity import features, ftrl, score_toxicity, train_toxicity

SF = Path("/root/testdata/sf0.001")
ODD = ["", "plain words here.", "Don't we'll they're 'quoted' it's", "ÀÉ œuvre naïve ß", "é combining", "ΣΑΣ final ΟΔΟΣ", "İstanbul", "tab\tand\nline\x0bfeed\x1cfs\x85nel nbsp", "<|endoftext|> and <|startoftext|>x", "12345 3.14 a1b2",
       "###tag$$$ &&& ***.", "word.,, end...", "漢字かな交じり文", "emoji 😀👍🏽 ok", "x" * 3000, "''s 's't", "a.b.c,d", "ﬁ ligature ½ ²", "_under_score_ `tick` ~tilde~", "​zero​width", "ǅ ǆ", "ᾳ"]


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_encoder_equals_the_library():
    draw = random.Random(2)
    pieces = [w for t in ODD for w in t.split(" ")]
    texts = ODD + [" ".join(draw.choice(pieces) for _ in range(draw.randint(0, 30))) for _ in range(300)]
    if SF.exists():
        import pyarrow.parquet as pq

        texts += [t or "" for t in pq.read_table(SF / "documents.parquet").column("text").to_pylist()]
    one, other = encoder(default_tokenizer()), reference()
    for t in texts:
        assert np.frombuffer(one.encode(t), "<u2").tolist() == other.encode(t, add_special_tokens=False).ids, t[:80]


def documents(spark, n=60):
    draw = random.Random(5)
    rows = [(i * 3 - 20, " ".join(draw.choice(["alpha", "beta,", "gamma.", "delta42", "é"]) for _ in range(int(draw.expovariate(1 / 300))))) for i in range(n)]
    rows += [(5000, None), (5001, ""), (5002, "long " * 20_000), (8, "again a row"), (8, "again a row"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pack_covers_every_id_once_without_padding(spark):
    docs, other = documents(spark), reference()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(other.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(docs, with_ids=True).collect():
        assert crc(np.frombuffer(r["ids"], "<u2")) == r["ids_crc32"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for d, versions in texts.items():
        spans = sorted((r["start"], r["length"]) for r in pieces[d])
        assert sum(n for _, n in spans) == sum(map(len, versions)) and {r["doc_tokens"] for r in pieces[d]} == {len(v) for v in versions}
        if len(versions) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == crc(versions[0][at : at + r["length"]])
                at += r["length"]
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 4096 or at < 4096 and at & (at - 1) == 0
    assert pack(docs.where("false")).count() == 0


def test_packer_takes_the_level_with_the_least_sum_of_squares():
    draw, out = random.Random(1), []
    p = Packer(20, out.append, max_open=10**9)
    for _ in range(400):
        size = draw.randint(1, 20)
        before = {h: n for h, n in enumerate(p.counts.tolist()) if n}

        def after(h):
            c = dict(before)
            if h:
                c[h] -= 1
            if h + size < 20:
                c[h + size] = c.get(h + size, 0) + 1
            return sum(n * n for n in c.values())

        best = min(after(h) for h in [0, *before] if h + size <= 20)
        p.add(("d", size), b"\1\0" * size)
        assert int((p.counts**2).sum()) == best


def test_packer_bounds_open_windows():
    out = []
    p = Packer(16, out.append, max_open=5)
    for _ in range(1000):
        p.add(("d", 9), b"\1\0" * 9)
        assert p.n_open <= 6
    p.finish()
    assert sum(len(ids) // 2 for w in out for _, _, ids in w) == 9000
    assert all(sum(len(ids) // 2 for _, _, ids in w) in (16, 8, 4, 2, 1) for w in out)


def test_store_round_trip_and_random_access(spark, tmp_path):
    docs, other = documents(spark), reference()
    folder = str(tmp_path / "store")
    manifest = write_store(docs, folder)
    rows = read_store(spark, folder, manifest).collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = other.encode(text, add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"]) == (at, len(ids)) and r["ids_crc32"] == crc(ids)
        at += len(ids)
    name = manifest[-1]["file"]
    path = Path(folder, name)
    with path.open("rb") as f:
        reader = StoreReader(f, path.stat().st_size)
        some = int(reader.docs[-1, 0])
        assert list(reader.find([some, 10**12])) == [some]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()  # the format's frames are plain zstandard
    assert len(whole) >= 2 * sum(m["tokens"] for m in manifest if m["file"] == name)
    damaged = bytearray(path.read_bytes())
    damaged[int(reader.at[0]) + 12] ^= 0xFF
    path.write_bytes(damaged)
    with path.open("rb") as f, pytest.raises(Exception):  # noqa: B017, PT011
        StoreReader(f, path.stat().st_size).ids(0)
    assert read_store(spark, folder, write_store(docs.where("false"), folder)).count() == 0


def test_features_count_words_pairs_and_skips():
    assert len(features("")) == 0 and len(features("... !!")) == 0
    assert len(features("one")) == 1 and len(features("one two three")) == 3 + 2 + 1
    assert set(features("Idiot!!")) == set(features("idiot"))


def test_ftrl_is_sparse_and_right():
    draw = np.random.default_rng(1)
    rows = [np.unique(np.append(draw.integers(100, 5000, 30), 7)) if k % 3 == 0 else np.unique(draw.integers(100, 5000, 30)) for k in range(900)]
    y = np.array([k % 3 == 0 for k in range(900)], float)
    slots, weights, bias = ftrl(rows, y)
    assert len(slots) < 200 and weights[list(slots).index(7)] > 1 and bias < 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.95), ("op8_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = q.queries()[name](spark, sf)
    assert rows.count() == docs.count() and rows.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> int(score >= 0.5)").count() == 0
    held = rows.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, n = held.agg(F.sum((F.col("predicted") == F.col(label)).cast("int")), F.count(F.lit(1))).first()
    assert good / n >= least


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (3, None, None), (None, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        scores = [r["score"] for r in score_toxicity(docs, train_toxicity(docs, labels, F.lit(True))).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
        stats = document_statistics(docs)
        scores = [r["score"] for r in score_quality(stats, train_quality(stats, labels, F.lit(True))).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert score_toxicity(docs.where("false"), train_toxicity(docs, none, F.lit(True))).count() == 0


def test_isotonic():
    got = isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1]))
    assert got.tolist() == [0, 1 / 3, 1 / 3, 1]
