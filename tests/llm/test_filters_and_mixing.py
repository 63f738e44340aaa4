"""Line rules, URL rules and mixing: brute force, edge cases, SQL."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing
from textloom.llm import queries as q
from textloom.llm.line_rules import clean_lines, examine, repeated_words
from textloom.llm.url_rules import SITE_RULES, compiled, judge, safe_tokens

SF = Path("/root/testdata/sf0.001")
SPACE = " \t\n\x0b\x0c\r"
PROSE = "The old house stood near the river. It was quiet in the morning, and the birds sang. Nobody came by."


def brute_repeat(words, n=8):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)})


def test_repeated_words_against_brute_force():
    draw = random.Random(3)
    for _ in range(60):
        words = [draw.choice("ab") for _ in range(draw.randint(0, 60))] if draw.random() < 0.7 else ["x"] * draw.randint(0, 20)
        assert repeated_words([w.encode() for w in words]) == brute_repeat(words)


def test_line_rules():
    kept = lambda text: examine(text)[8]
    assert kept(PROSE) == PROSE
    assert kept(f"Home | News | About | Contact\n{PROSE}\nAll rights reserved.\nno end here at all\nbuy$$$ now### cheap&&& deal***.\nRead more") == PROSE
    assert kept(f"{PROSE}\n\n{PROSE.upper()}") == f"{PROSE}\n\n{PROSE.upper()}"
    assert examine(PROSE)[7] is True and examine("Home | News | About | Contact\n" * 9)[7] is False


def test_base_values():
    text = "A# b\nA# b\n \nc\x0bd $|"
    n, chars, symbols, dup, repeat, base = examine(text)[:6]
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    assert (n, chars, symbols, dup, repeat, base) == (len(words), sum(map(len, words)), 4, 1, 0, True)


def test_clean_lines_on_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, SPACE, 5), (4, PROSE, 5), (4, PROSE, 5), (5, (PROSE + "\n") * 2000, 5), (None, PROSE, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long").withColumn("kept", F.lit("clash"))
    out = clean_lines(df)
    got = {(r["doc_id"], r["n_words"], r["kept"]) for r in out.collect()}
    n = len(PROSE.split())
    assert got == {(1, 0, False), (2, 0, False), (3, 0, False), (4, n, True), (5, 2000 * n, False), (None, n, True)}
    assert [r["clean_text"] for r in out.where("doc_id = 1").collect()] == [""] and clean_lines(df.where("false")).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s] + 1e-9}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_against_rounds_of_sharing(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}": draw.randint(0, 1000) * (20 if i == 3 else 1) for i in range(11)} | {None: 55, "é": 10, "Z": 9}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def corpus(spark, seed=1):
    draw = random.Random(seed)
    rows = [(i, draw.choice(["a", "a", "a", "b", "c", None]), "w " * draw.randint(0, 60)) for i in range(700)]
    rows += [(1000 + i, "a", "same size text here") for i in range(300)] + [(3, "a", "again"), (None, "b", "x y"), (9000, "b", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("limit", [None, 0])
def test_mix_meets_targets(spark, limit):
    docs = corpus(spark).withColumn("Size", F.lit("clash")).withColumn("n", F.lit(1))
    rows = mixing.mix(docs, limit=limit).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == docs.count()
    per = {}
    for r in rows:
        assert 0 <= r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and r["n"] == 1
        s = per.setdefault(r["source"], [0, 0, r["source_size"], r["target"], 0])
        s[0] += r["size"]
        s[1] += r["taken"]
        s[4] = max(s[4], r["size"])
    for size, taken, source_size, target, longest in per.values():
        assert size == source_size and abs(taken - target) <= 2 * longest + 2
    assert mixing.mix(docs.where("false")).count() == 0
    made = mixing.repeated(mixing.mix(docs.select("doc_id", "source", "text")))
    assert made.count() == sum(r["copies"] for r in rows)


def test_nothing_but_empty_texts(spark):
    docs = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert {(r["doc_id"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


URLS = ["http://example.com/en/1", "https://WWW.Example.COM/en/x?y#z", "http://a.b.net/es/", "http://net/fr/q", "http://example.com", "http://xcom/en/", "no scheme", None, "", "://", "http://example.com:80/en/",
        "ftp://example.com?x=://net/es/", "http://m.casino-win.org/x", "http://foo.org/casinos", "http://foo.org/login", "http://foo.org/login/now", "http://foo.org/blogin/", "http://example.com/EN/", "http://foo.net/en/#/es/"]


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fits = [(len(r), r, a) for a, r in SITE_RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(re.search(r["regex"], url or "") for r in compiled() if not r["site"])
    return host, path, None, "block" if bad else "allow"


def test_judge_against_trying_every_rule(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string")
    got = judge(df).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_judge(r["url"]), r["url"]
    assert judge(df.where("false")).count() == 0
    assert judge(df, sites=(), patterns=("*ads*",)).where("verdict = 'block'").count() == 0


def test_index_tokens():
    assert safe_tokens("*/login^") == ["login"] and safe_tokens("*ads*") == [] and safe_tokens("^a^bc") == ["a"]


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = q.queries()[name](spark, str(SF)), con.sql(q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    flat = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    mine = sorted((tuple(flat(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert mine == sorted((tuple(flat(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_rows_of_one_size_are_ranked_by_id_in_any_number_of_tasks(spark):
    draw = random.Random(9)
    ids = draw.sample(range(10_000), 90)
    docs = spark.createDataFrame([(i, "s", " ".join(["w"] * draw.choice([3, 3, 3, 5]))) for i in ids], "doc_id long, source string, text string")
    rows = lambda: sorted((r["doc_id"], r["copies"]) for r in mixing.mix(docs).collect())
    want = rows()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
