"""The stateful stream fires what the batch windows fire."""

import json

from pyspark.sql import functions as F

from textloom.operators import live as lv
from textloom.streaming.live_stream import live_triggers, perplexity


def test_stream_equals_batch(spark, tmp_path):
    rows = []
    for p in range(4):
        n = 23 + p
        for i in range(n):
            words = [f"w{(i * 7 + p) % 11}"] if (i + p) % 6 else [f"x{i % 5}", f"y{i}"]
            rows.append({"passage_id": f"p{p}", "token_index": i, "words": words, "is_last": i == n - 1})
    folder = tmp_path / "in"
    folder.mkdir()
    half = [r for r in rows if r["token_index"] % 2 == 0], [r for r in rows if r["token_index"] % 2]
    for k, part in enumerate(half):  # odd tokens come in a later file than their neighbours
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
    score = lambda window: float(sum(len(w) * (i + 1) for i, w in enumerate(window)) % 17 + 1)
    stream = spark.readStream.schema("passage_id string, token_index long, words array<string>, is_last boolean").option("maxFilesPerTrigger", 1).json(str(folder))
    query = live_triggers(stream, score).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["passage_id"], r["token_index"]): (r["n_words"], round(r["z"], 9), r["alert"]) for r in spark.table("fired").collect()}
    records = spark.createDataFrame([(r["passage_id"], r["token_index"], r["words"]) for r in rows], "passage_id string, token_index long, final_words array<string>")
    fired = lv.triggers(records, "passage_id")
    length = F.aggregate(F.transform("window", lambda w, i: F.length(w) * (i + 1)), F.lit(0), lambda a, x: a + x)
    batch = lv.robust_z(fired.withColumn("pp", (length % 17 + 1).cast("double")), "passage_id", "seq", "pp")
    want = {(r["passage_id"], r["token_index"]): (r["cum"], round(r["z"], 9), r["history"] >= 3 and r["z"] >= 2.5) for r in batch.collect()}
    assert got == want and len(want) > 10


def test_perplexity_of_a_window():
    grams, histories = {("<s>", "a"): 3, ("a", "</s>"): 1}, {("<s>",): 4, ("a",): 2}
    p = perplexity(["a"], (grams, histories), 5, 2, 0.01)
    assert round(p, 6) == round(((3.01 / 4.07) * (1.01 / 2.07)) ** -0.5, 6)
    assert perplexity([], (grams, histories), 5, 2, 0.01) == 0.0
