"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, settle

#: Rounds are logarithmic in a component's diameter; more means a fault.
MAX_ROUNDS = 60


def _are_stars(links: DataFrame) -> bool:
    """Whether distinct links (a, b), b < a, tie every a to one b that is tied to nothing: then b is its component's least."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("tied"), F.lit(0).alias("hub"))
    ends = ends.unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("tied"), F.lit(1).alias("hub")))
    found = ends.groupBy("id").agg(F.sum("tied").alias("tied"), F.max("hub").alias("hub")).where("tied + hub > 1")
    return not found.limit(1).count()


def connected_components(links: DataFrame) -> DataFrame:
    """Settled (id, component) of every id in ``links`` (a, b); component is the least id reachable. Null ends are left out,
    links of an id to itself and repeated links are harmless; without links the result is empty.

    Alternates two rewritings until every component is a star: large stars tie an id's larger neighbours to its least
    neighbour, small stars tie its smaller neighbours and itself to it. The table never grows; each round is two
    combinable minimum aggregations and joins on an id. A hub's links meet one row per hub, which adaptive execution
    splits. Rounds are written to the shared folder.
    """
    stars = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _are_stars(stars):
            break
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = settle(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        small = settle(small.where("a <> b").distinct(), "small")
        discard(large, stars)
        stars = small
    else:
        raise RuntimeError("components did not settle")
    ends = stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    out = settle(ends, "components")
    discard(stars)
    return out
