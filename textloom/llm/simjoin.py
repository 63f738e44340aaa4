"""Links between sets with a Jaccard similarity over a threshold, from bottom-k sketches of one hash function."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, settle
from textloom.llm.components import connected_components

#: Hashes a sketch keeps; the least INDEXED of them generate candidates, all of them estimate.
SKETCH, INDEXED = 64, 24
#: The inverted lists and the estimate may each miss a link with this probability at most, if its similarity is just the
#: threshold.
MISS = 1e-7
#: Members up to which a list's pairs are made one by one; longer lists go by their centre.
LIST = 32
#: Additions to a group's centre that more than a COMMONth of its members hold come last in the order of their lists; a
#: group has at most COMMON times as many such items as a member has on average.
COMMON = 32


def shared_least(num: int, den: int, indexed: int = INDEXED) -> int:
    """How many of their ``indexed`` least hashes two sets with similarity num / den share, but for MISS.

    Among the ``indexed`` least hashes of the union, those in both sets are in both sketches; each is in both with
    probability num / den."""
    p, total = num / den, 0.0
    for m in range(indexed):
        total += math.comb(indexed, m) * p**m * (1 - p) ** (indexed - m)
        if total > MISS:
            return max(m, 1)
    return indexed


def least_estimate(num: int, den: int, sketch: int = SKETCH) -> float:
    """The share of the union's ``sketch`` least hashes that two sets with similarity num / den have in common, but for
    MISS."""
    return shared_least(num, den, sketch) / sketch


def _index(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Inverted lists (v, id, n): each set under the rarest of its INDEXED least hashes.

    Sets that share m of these hashes share one among all but the m - 1 most frequent of each, ordered by how many sets
    hold a hash; so common passages and phrases generate nothing. Hashes that one set alone holds need no list, but
    take their places in that order."""
    rows = sets.select("id", "n", F.explode(F.slice("sketch", 1, INDEXED)).alias("v"))
    held = rows.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = F.least(F.col("n"), F.lit(INDEXED))
    need = F.least(F.lit(shared_least(num, den)), F.ceil(own * num / den))
    lists = rows.join(held, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    places = F.greatest(own - need + 1 - (own - F.size("vs")), F.lit(0)).cast("int")
    return lists.select("id", "n", F.explode(F.slice("vs", 1, places)).alias("x")).select(F.col("x.v").alias("v"), "id", "n")


def _near_size(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _verified(pairs: DataFrame, sets: DataFrame, full_sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Pairs (a, b) that pass the estimate from the union's sketch, then the exact count over full sets."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"k{s}"))
    est = pairs.join(side("a"), "a").join(side("b"), "b")
    k = F.when((F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH), F.lit(2 * SKETCH)).otherwise(F.lit(SKETCH))
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), F.lit(1), k)
    both = F.size(F.array_intersect(F.array_intersect("ka", "kb"), union))
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH)
    enough = F.when(whole, both * den >= F.size(union) * num).otherwise(both >= F.lit(least_estimate(num, den)) * F.size(union))
    good = settle(est.where(enough).select("a", "b", whole.alias("sure")), "estimated")
    sure, open_ = good.where("sure").select("a", "b"), good.where("NOT sure").select("a", "b")
    wanted = settle(open_.select(F.col("a").alias("id")).union(open_.select("b")).distinct(), "wanted")
    full = settle(full_sets(wanted), "full")
    side = lambda s: full.select(F.col("id").alias(s), F.col("items").alias(f"s{s}"))
    exact = open_.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    exact = exact.where(shared * den >= (F.size("sa") + F.size("sb") - shared) * num).select("a", "b")
    out = settle(sure.union(exact), "verified")
    discard(good, wanted, full)
    return out


def _differences(groups: DataFrame, full_sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Settled (h, id, g, d, a) of the members of groups (h, id): their differences from the group's centre, the
    rare ones first: what is missing by how many members miss it, additions by their hash, but common ones behind all
    others, by how many members hold them. So the prefixes that are listed leave out what would make most pairs.

    The centre c is what more than half of a group's sets hold. With D(x) = c - x, A(x) = x - c and
    overlap(x, y) = |D(x) & D(y)| + |A(x) & A(y)|, the intersection of x and y is |c| - |D(x)| - |D(y)| + overlap(x, y);
    so they are linked exactly if 2 (num + den) overlap(x, y) >= G(x) + G(y), where
    G(x) = 2 num |x| - (num + den) (|c| - 2 |D(x)|)."""
    ids = settle(groups.select("id").distinct(), "ids")
    full = settle(full_sets(ids), "items")
    members = settle(groups.join(full, "id"), "members")
    held = members.select("h", F.explode("items").alias("s")).groupBy("h", "s").agg(F.count(F.lit(1)).alias("df"))
    sizes = groups.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    in_order = lambda which, o: F.sort_array(F.collect_list(F.when(which, F.struct(o.alias("o"), "s"))))["s"]
    most, df = F.col("df") * 2 > F.col("size"), F.col("df")
    centre = held.join(sizes, "h").where(df * COMMON > F.col("size")).groupBy("h").agg(in_order(most, -df).alias("c"), in_order(~most, df).alias("u"))
    centre = settle(centre, "centres")
    rows = members.join(centre, "h", "left").withColumns({k: F.coalesce(k, F.array().cast("array<long>")) for k in ("c", "u")})
    added = F.concat(F.array_sort(F.array_except(F.array_except("items", "c"), "u")), F.array_intersect("u", "items"))
    rows = rows.select("h", "id", F.size("items").alias("n"), F.size("c").alias("nc"), F.array_except("c", "items").alias("d"), added.alias("a"))
    rows = rows.withColumn("g", F.lit(2 * num) * F.col("n") - F.lit(num + den) * (F.col("nc") - 2 * F.size("d")))
    out = settle(rows.select("h", "id", "g", "d", "a"), "differences")
    discard(ids, full, members, centre)
    return out


def _enough_overlap(pairs: DataFrame, rows: DataFrame, unit: Column) -> DataFrame:
    """Pairs (a, b) of (h, a, b) that are linked: counted exactly on their differences."""
    side = lambda s: rows.select("h", F.col("id").alias(s), F.col("g").alias(f"g{s}"), F.col("d").alias(f"d{s}"), F.col("a").alias(f"a{s}"))
    both = pairs.join(side("a").withColumnRenamed("aa", "xa"), ["h", "a"]).join(side("b").withColumnRenamed("ab", "xb"), ["h", "b"])
    overlap = F.size(F.array_intersect("da", "db")) + F.size(F.array_intersect("xa", "xb"))
    return both.where(overlap * unit >= F.col("ga") + F.col("gb")).select("a", "b")


def around_centres(groups: DataFrame, full_sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Links (a, b) within large groups (h, id), enough of them for the components, without all pairs of a group.

    With U = 2 (num + den), x and y are linked if the overlap of their differences is (G(x) + G(y)) / U or more (see
    _differences). Let s be the member with the least G. Every y with G(y) + G(s) <= 0 is linked to s: one row per
    member. For any other x, an open one, the overlap with whatever it is linked to is m = (G(x) + G(s)) / U or more,
    and as no more than the lesser number of items can be missing from both, at least G(x) / U + E of it are items that
    both add to the centre, where E is the least G(y) / U - |D(y)| of the group. (For the partner that is not open, s and
    E are taken over the open members.) So a member lists all but the last of its additions, and only if it may be
    linked without a common addition, all but the last m - 1 of what it misses. Linked members share what they list.
    Copies edited apart share no additions. Without a common addition, a link depends on what is missing and on G alone:
    so of members that miss the same, the one with the least G leads, and if x is linked to y in this way, with
    G(x) >= G(y), x is linked to y's leader, and so is y if it is not open: leaders alone are looked up by what is missing.

    Of each item listed the holder with the least G stands for it: open members are first compared with these, one row
    per item. What is linked then forms components; items whose holders all lie in one are done. Only open members that
    share another item with a member of another component, and as many as their numbers ask for, are compared.
    """
    unit = F.lit(2 * (num + den))
    rows = _differences(groups, full_sets, num, den)
    e = F.col("g") / unit - F.size("d")
    first = rows.groupBy("h").agg(F.min(F.struct("g", "id")).alias("s"), F.min(e).alias("e"))
    opened = rows.join(first, "h").where("g + s.g > 0").groupBy("h").agg(F.min("g").alias("go"), F.min(e).alias("eo"))
    first = settle(first.join(opened, "h", "left").select("h", F.col("s.g").alias("gs"), F.col("s.id").alias("s"), "e", "go", "eo"), "nearest")
    placed = rows.join(first, "h").withColumn("open", F.col("g") + F.col("gs") > 0).withColumn("class", F.xxhash64("d"))
    leaders = settle(rows.groupBy("h", F.xxhash64("d").alias("class")).agg(F.min(F.struct("g", "id"))["id"].alias("leader")), "leaders")
    placed = placed.join(leaders, ["h", "class"]).withColumn("leads", F.col("leader") == F.col("id"))
    near = placed.where("NOT open AND id <> s").select(F.col("id").alias("a"), F.col("s").alias("b"))
    partner = lambda of_open, of_rest: F.when(F.col("open"), F.col(of_open)).otherwise(F.col(of_rest))
    both = F.ceil(F.round(F.col("g") / unit + partner("e", "eo"), 6)).cast("int")
    need = F.greatest(F.ceil((F.col("g") + partner("gs", "go")) / unit), F.lit(1)).cast("int")
    listed = placed.where("go IS NOT NULL").withColumn("ra", F.least(F.greatest(both, F.lit(1)) - 1, F.size("a"))).withColumn("rd", F.when((both <= 0) & (F.col("open") | F.col("leads")), F.least(need - 1, F.size("d"))).otherwise(F.size("d")))
    prefix = lambda c, rest, mark: F.transform(F.slice(c, F.lit(1), F.size(c) - F.col(rest)), lambda x: F.struct(F.lit(mark).alias("d"), x.alias("s")))
    each = listed.select("h", "id", "g", "open", "leads", F.size("d").alias("nd"), F.size("a").alias("na"), "ra", "rd", F.explode(F.concat(prefix("a", "ra", False), prefix("d", "rd", True))).alias("x"))
    each = each.select("h", "id", "g", "open", "leads", "nd", "na", "ra", "rd", "x.d", "x.s")
    shared = each.groupBy("h", "d", "s").agg(F.count(F.lit(1)).alias("df"), F.max("open").alias("any"), F.min(F.struct("g", "id")).alias("rep")).where("df > 1 AND any")
    items = settle(each.join(shared.select("h", "d", "s", "rep"), ["h", "d", "s"]), "shared")

    stand = items.where("open AND rep.id <> id").select("h", F.col("id").alias("a"), F.col("rep.id").alias("b")).distinct()
    stars = settle(near.union(_enough_overlap(stand, rows, unit)), "stand-ins")
    components = connected_components(stars)
    placed = items.drop("rep").join(components, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mixed = placed.groupBy("h", "d", "s").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.max("open").alias("any")).where("least < most AND any")
    placed = settle(placed.join(mixed.select("h", "d", "s"), ["h", "d", "s"]), "mixed-items")
    side = lambda s: placed.select("h", "d", "s", *[F.col(n).alias(n + s) for n in ("id", "g", "open", "leads", "nd", "na", "ra", "rd", "c")])
    order = F.when(F.col("d"), F.col("leadsb") & (F.col("ga") >= F.col("gb"))).otherwise(~F.col("openb") | (F.col("ida") < F.col("idb")))
    met = (F.col("ida") != F.col("idb")) & (F.col("ca") != F.col("cb")) & F.col("opena") & order
    least = lambda n: F.least(f"{n}a", f"{n}b")
    can = (least("nd") + least("na")) * unit >= F.col("ga") + F.col("gb")
    pairs = side("a").join(side("b"), ["h", "d", "s"]).where(met & can)
    sums = F.sum(F.when(F.col("d"), 0).otherwise(1)).alias("added"), F.sum(F.col("d").cast("int")).alias("missed")
    pairs = pairs.groupBy("h", F.col("ida").alias("a"), F.col("idb").alias("b"), (F.col("ga") + F.col("gb")).alias("g"), least("nd").alias("nd"), F.greatest("raa", "rab").alias("ra"), F.greatest("rda", "rdb").alias("rd")).agg(*sums)
    enough = F.when(F.col("added") > 0, F.col("added") + F.col("ra") + F.col("nd")).otherwise(F.col("missed") + F.col("rd"))
    close = settle(pairs.where(enough * unit >= F.col("g")).select("h", "a", "b"), "close")
    out = settle(stars.union(_enough_overlap(close, rows, unit)), "centre-links")
    discard(rows, first, leaders, items, stars, components, placed, close)
    return out


def _merged(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups (h, id) whose heads h have a quarter of their sketches in common and that share a member become one: the lists of a
    crowd of near copies have several heads, and most members would come up under each."""
    first = groups.groupBy("id").agg(F.min("h").alias("a"))
    pairs = settle(groups.join(first, "id").where("h <> a").select("a", F.col("h").alias("b")).distinct(), "heads")
    side = lambda s: sets.select(F.col("id").alias(s), F.col("sketch").alias(f"k{s}"))
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, SKETCH)
    alike = 4 * F.size(F.array_intersect(F.array_intersect("ka", "kb"), union)) >= F.size(union)
    to = connected_components(pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b"))
    out = groups.join(to.withColumnRenamed("id", "h"), "h", "left").select(F.coalesce("component", "h").alias("h"), "id").distinct()
    out = settle(out, "merged")
    discard(groups, pairs, to)
    return out


def linked(sets: DataFrame, full_sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(id, component) of every id that is linked to another one: size of intersection / size of union >= num / den.

    ``sets``: settled table (id, n, sketch), one row per distinct set; sketch holds its SKETCH least hashes in order.
    ``full_sets``: from a table of ids to (id, items), one row each. Components are exact but for twice MISS per link.

    An inverted list of n sets has n^2 pairs, so they are not made. First each list's least id stands for the list and
    its members are verified against it, n pairs; what links forms components. A list whose members all lie in one
    component is done. Of the others, lists of at most LIST members make the pairs between components, and the longer
    ones, put together by the component of that least id, are searched around their centre.
    """
    index = settle(_index(sets, num, den), "index")
    hubs = settle(index.groupBy("v").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("m")), "hubs")
    pairs = index.join(hubs, "v").where((F.col("id") != F.col("hub.id")) & _near_size(F.col("n"), F.col("hub.n"), num, den))
    pairs = settle(pairs.select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct(), "pairs")
    stars = _verified(pairs, sets, full_sets, num, den)
    components = connected_components(stars)
    placed = settle(index.join(components, "id", "left").select("v", "id", "n", F.coalesce("component", "id").alias("c")), "placed")
    mixed = placed.groupBy("v").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("v")
    mixed = mixed.join(hubs, "v").select("v", "m", F.col("hub.id").alias("id")).join(components, "id", "left")
    mixed = settle(mixed.select("v", "m", F.coalesce("component", "id").alias("h")), "mixed")
    lists = placed.join(mixed.where(F.col("m") <= LIST).select("v"), "v")
    left = lists.select("v", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    right = lists.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    rest = left.join(right, "v").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near_size(F.col("na"), F.col("nb"), num, den))
    rest = rest.select("a", "b").distinct()
    groups = settle(placed.join(mixed.where(F.col("m") > LIST).select("v", "h"), "v").select("h", "id").distinct(), "groups")
    groups = _merged(groups, sets)
    central = around_centres(groups, full_sets, num, den)
    rest = settle(rest.join(pairs.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")), ["a", "b"], "left_anti"), "rest")
    found = _verified(rest, sets, full_sets, num, den)
    more = settle(found.union(central), "more")
    out = connected_components(stars.union(more)) if more.count() else components
    discard(index, hubs, pairs, stars, placed, mixed, groups, central, rest, found, more, *([components] if out is not components else []))
    return out
