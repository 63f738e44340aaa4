"""The pipeline, stage by stage against plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline
from textloom.llm.line_rules import examine


def prose(spark):
    """Documents with junk, exact and near copies."""
    import random

    draw = random.Random(1)
    def sentence():
        return " ".join(draw.choice(["river", "stone", "the", "house", "of", "green", "walk", "light", "door", "under"]) + str(draw.randint(0, 99)) for _ in range(9)).capitalize() + "."

    rows = []
    for i in range(60):
        text = " ".join(sentence() for _ in range(8))
        rows.append((i, text))
        if i % 5 == 0:
            rows.append((100 + i, text.upper()))
        if i % 7 == 0:
            rows.append((200 + i, text.replace(".", " indeed.", 1)))
    rows += [(300, "Home | News | About | Contact\n" * 30), (301, None), (302, ""), (303, rows[3][1] + "\nAll rights reserved.")]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = prose(spark)
    folder = tmp_path / "sf"
    docs.write.parquet(str(folder / "documents.parquet"))
    at, seen = spark.read.parquet(str(folder / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(folder))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        at = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        seen.append(Counter(r["doc_id"] for r in at.collect()))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i: examine(t or "")[8] for i, t in texts.items() if examine(t or "")[7]}
    assert set(seen[0]) == set(clean)
    groups = defaultdict(list)
    for i, t in clean.items():
        groups[t.lower()].append(i)
    assert set(seen[1]) == {max(g) for g in groups.values()}
    assert set(seen[2]) < set(seen[1]) and max(seen[2].values()) == 1
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].values()) <= 2
    packed = corpus_pipeline.run(spark, str(folder)).collect()
    assert {r["doc_id"] for r in packed} == set(seen[3])
    tokens = Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    assert all(tokens[r["doc_id"]] == r["doc_tokens"] * seen[3][r["doc_id"]] for r in packed)


def test_empty(spark, tmp_path):
    docs = prose(spark).where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]


def test_batches_of_long_texts_stay_small(spark):
    """What a worker gets at once is bounded by bytes, not by Spark's 64 MB; all rows arrive."""
    import pyarrow as pa

    from textloom.session import BATCH_BYTES, prepare

    prepare(spark)
    docs = spark.range(0, 200, 1, 1).selectExpr("id", "repeat('word ', 20000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["b", "n"])

    got = docs.mapInArrow(sizes, "b long, n long").collect()
    assert sum(r["n"] for r in got) == 200 and max(r["b"] for r in got) <= BATCH_BYTES + 200_000


def test_words_can_be_given_back():
    """Packing gives back the table of words that an earlier stage left in its worker."""
    from textloom.llm import packing
    from textloom.llm.words import _hashes, word_hashes

    word_hashes([b"one", b"two"])
    assert _hashes
    packing.forget()
    assert not _hashes and word_hashes([b"one"]).tolist() == [_hashes[b"one"]]
