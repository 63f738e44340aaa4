"""CoNLL-U files as a token table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The ten fields of the format.
FIELDS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def parse_conllu(files: DataFrame) -> DataFrame:
    """(path, sent, pos, form, lemma, upos, feats) from rows (path, value) that hold whole files.

    Lines are trimmed; an empty line ends a sentence, # starts a comment, lines without exactly ten fields and ids with
    - or . are left out; features "_" are an empty map. Sentences are numbered inside a file, by its array of lines."""
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("block", F.sum((F.col("line") == "").cast("int")).over(before))
    rows = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).withColumn("f", F.split("line", "\t"))
    rows = rows.where((F.size("f") == len(FIELDS)) & ~F.col("f")[0].rlike(r"[-.]"))
    feats = F.when(F.col("f")[5] == "_", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(F.col("f")[5], F.lit(r"\|"), F.lit("=")))
    rows = rows.withColumn("sent", F.dense_rank().over(Window.partitionBy("path").orderBy("block")) - 1)
    pos = F.row_number().over(Window.partitionBy("path", "sent").orderBy("n")) - 1
    return rows.select("path", "sent", pos.alias("pos"), F.col("f")[1].alias("form"), F.col("f")[2].alias("lemma"), F.col("f")[3].alias("upos"), feats.alias("feats"))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return parse_conllu(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def read_splits(spark: SparkSession, folder: str, names: dict[str, str] | None = None) -> DataFrame:
    """The files of a folder with a column split; a missing file is an error."""
    parts = [read_conllu(spark, f"{folder.rstrip('/')}/{file}").withColumn("split", F.lit(split)) for split, file in (names or {"train": "train.conllu", "dev": "dev.conllu", "test": "test.conllu"}).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
