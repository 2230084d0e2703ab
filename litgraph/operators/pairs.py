"""Related-paper pairs by shared attributes or vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from litgraph.functions.scores import cosine
from litgraph.operators.joins import cap, exclude_pairs, top_per, union_sources, with_titles
from litgraph.runtime import cut_lineage, has_rows

BLOCK = 2000  # members of one key that meet in one join group
FEW = 16  # keys of an id up to which every two of them are written out
CARRIED = 64  # ends of a paper up to which they travel with it


def key_pairs(df: DataFrame, key, id_col: str, df_min: int = 2, df_cap: int | None = None,
              carry=(), block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b for every key that both have; one row per pair and key.

    ``df`` has one row per (key, id). Keys with fewer than ``df_min`` or more than ``df_cap``
    ids are left out. A key with more than ``block`` ids is split: its ids are dealt to parts
    and every two parts meet in their own join group, so no group exceeds two parts.
    """
    keys = [key] if isinstance(key, str) else list(key)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if df_cap is not None or df_min > 2:
        sized = df.join(sizes.filter((F.col("_n") >= df_min) & (F.col("_n") <= df_cap if df_cap is not None else F.lit(True))), keys)
    else:  # single ids meet nobody, so only the few keys that are split need their sizes
        sized = df.join(F.broadcast(sizes.filter(F.col("_n") > block)), keys, "left")
    parts = F.coalesce(F.ceil(F.col("_n") / F.lit(block)).cast("int"), F.lit(1))
    dealt = (
        sized.withColumn("_parts", parts)
        .withColumn("_p", F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select(*keys, id_col, *carry, "_p",
                F.least("_p", "_q").alias("_i"), F.greatest("_p", "_q").alias("_j"))
    )
    side = lambda s: dealt.select(
        *keys, "_i", "_j", F.col("_p").alias(f"_p{s}"), F.col(id_col).alias(s),
        *[F.col(c).alias(f"{c}_{s}") for c in carry])
    met = side("a").join(side("b"), [*keys, "_i", "_j"])
    once = (F.col("_i") == F.col("_j")) | (F.col("_pa") != F.col("_pb"))
    return met.filter((F.col("a") < F.col("b")) & once).drop("_i", "_j", "_pa", "_pb")


def shared_counts(df: DataFrame, key: str, id_col: str, min_shared: int, df_cap: int | None = None,
                  block: int = BLOCK) -> DataFrame:
    """Pairs of ids with at least ``min_shared`` keys in common, and how many."""
    pairs = key_pairs(df, key, id_col, df_cap=df_cap, block=block)
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared_count")).filter(
        F.col("shared_count") >= min_shared)


def _ranked_keys(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, id, r) of distinct rows: r numbers the keys of an id from the commonest on. Keys are hashes from here on."""
    rows = df.select(F.xxhash64(key).alias(key), id_col)
    sized = rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    w = Window.partitionBy(id_col).orderBy(F.desc("_n"), F.asc(key))
    return cut_lineage(sized.select(key, id_col, F.row_number().over(w).alias("r")))


def _pairs_by_bound(ranked: DataFrame, key: str) -> dict[int, float]:
    """For each bound, how many pairs meet on keys of at least that rank; one row per rank reaches the driver."""
    w = Window.partitionBy(key).orderBy(F.desc("r"))
    upto = ranked.groupBy(key, "r").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.sum("n").over(w).cast("double"))
    pairs = lambda m: m * (m - 1) / 2
    step = upto.groupBy("r").agg(F.sum(pairs(F.col("m")) - pairs(F.col("m") - F.col("n"))).alias("more"))
    made, out = 0.0, {}
    for row in sorted(step.collect(), key=lambda x: -x.r):
        made += row.more
        out[row.r] = made
    return out


def _key_sets(ranked: DataFrame, key: str, id_col: str) -> DataFrame:
    """(keys, id, r): every two keys of an id with few keys; of two ids with B keys in common, some two have r >= B."""
    few = ranked.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("r", F.col(key).alias("k")))).alias("ks")).filter(
        F.size("ks") <= FEW)
    first = few.select(id_col, "ks", F.posexplode("ks").alias("i", "x"))
    both = first.select(id_col, "x", F.explode(F.slice("ks", F.col("i") + 2, FEW)).alias("y"))
    return both.select(F.struct(F.col("x.k").alias("x"), F.col("y.k").alias("y")).alias("keys"), id_col, (F.col("x.r") + 1).alias("r"))


def top_shared(df: DataFrame, key: str, id_col: str, min_shared: int, limit: int, block: int = BLOCK) -> DataFrame:
    """The ``limit`` pairs with most keys in common, at least ``min_shared``; exact.

    Two ids with B keys in common share one that is not among the B - 1 commonest of either, so with bound B only such
    rarer keys are paired and the pairs found are counted over all keys. They also share two that are not among the B - 2
    commonest: from two shared keys on, ids with at most ``FEW`` keys meet on two at once, which far fewer pairs do by
    chance, and only ids with more keys meet the others on single ones. The first bound is the least one that makes pairs
    in proportion to the rows. Keys meet as hashes, and pairs that may have enough are counted over the keys themselves.
    If it leaves the limit open, bounds go down by one: all pairs with more keys are known
    then, and of those with exactly B the first in the order of ids are wanted, so the partners of the first ids are
    tried before those of all.
    """
    df = cut_lineage(df.select(key, id_col).distinct())
    ranked = _ranked_keys(df, key, id_col)
    keys_of = cut_lineage(ranked.groupBy(id_col).agg(F.collect_list(key).alias("ks")))
    rows = ranked.count()
    least = max(min_shared, 1)
    # What ids meet on: (key, id, r), and of the single keys beside sets whether an id has many.
    single = ranked.withColumn("many", F.lit(True))
    sets = None
    if least > 1:
        sets = cut_lineage(_key_sets(ranked, key, id_col))
        large = keys_of.filter(F.size("ks") > FEW).select(id_col, F.lit(True).alias("many"))
        single = None
        if has_rows(large):
            dealt = ranked.join(large, id_col, "left").withColumn("many", F.coalesce("many", F.lit(False)))
            single = cut_lineage(dealt.join(dealt.filter("many").select(key).distinct(), key, "left_semi"))
    upto = lambda found, b: found[min(x for x in found if x >= b)] if max(found, default=0) >= b else 0.0
    more = [_pairs_by_bound(part, on) for part, on in ((single, key), (sets, "keys")) if part is not None]
    made = {b: sum(upto(m, b) for m in more) for b in range(1, max((max(m, default=0) for m in more), default=0) + 1)}
    if not made:
        return _top_pairs(shared_counts(df.limit(0), key, id_col, min_shared), limit)

    def counted(cand: DataFrame, least: int) -> DataFrame:
        a, b = (keys_of.select(F.col(id_col).alias(x), F.col("ks").alias(f"_{x}")) for x in ("a", "b"))
        told = [F.size(c) == F.size(F.array_distinct(c)) for c in ("_a", "_b")]  # no two keys of an id with one hash
        most = F.when(told[0] & told[1], F.size(F.array_intersect("_a", "_b"))).otherwise(F.least(F.size("_a"), F.size("_b")))
        able = cut_lineage(cand.select("a", "b").distinct().join(a, "a").join(b, "b").filter(most >= least).select("a", "b"))  # of known size
        left, right = (df.select(F.col(id_col).alias(x), key) for x in ("a", "b"))
        return able.join(left, "a").join(right, ["b", key]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared_count")).filter(
            F.col("shared_count") >= least)

    def meeting(b: int, first: int | None = None) -> DataFrame:
        """Pairs that meet with bound ``b``, or those whose smaller id is among the first so many that meet any."""
        found = []
        rare = [(part.filter(F.col("r") >= b), on) for part, on in ((single, key), (sets, "keys")) if part is not None]
        start = None if first is None else union_sources(*[part.select(id_col) for part, _ in rare]).distinct().orderBy(id_col).limit(first)
        for part, on in rare:
            carry = ("many",) if on == key else ()
            if start is None:
                near = key_pairs(part.select(on, id_col, *carry), on, id_col, carry=carry, block=block)
            else:
                left, right = (part.select(F.col(id_col).alias(x), on, *[F.col(c).alias(f"{c}_{x}") for c in carry]) for x in ("a", "b"))
                near = left.join(start.withColumnRenamed(id_col, "a"), "a", "left_semi").join(right, on).filter(F.col("a") < F.col("b"))
            found.append((near.filter(F.col("many_a") | F.col("many_b")) if carry else near).select("a", "b"))
        return union_sources(*found)

    cheap = [b for b, n in made.items() if n <= rows and b >= least]
    bound = min(cheap, default=max(*made, least))
    known = cut_lineage(counted(meeting(bound), bound))
    while bound > least and not has_rows(known, limit):
        bound -= 1
        for first in (50, 2000):
            found = cut_lineage(known.unionByName(counted(meeting(bound, first), bound)).distinct())
            if has_rows(found, limit):
                return _top_pairs(found, limit)
        known = cut_lineage(counted(meeting(bound), bound))
    return _top_pairs(known, limit)


def shared_names(pairs: DataFrame, df: DataFrame, key: str, id_col: str, n: int | None = None) -> DataFrame:
    """Add the sorted shared keys of chosen pairs; only the first ``n`` when given.

    The pairs are used twice, so they are kept rather than found again.
    """
    pairs = cut_lineage(pairs)
    left = pairs.select("a", "b").join(df.select(F.col(id_col).alias("a"), key), "a")
    both = left.join(df.select(F.col(id_col).alias("b"), key), ["b", key])
    if n is not None:
        both = top_per(both, ["a", "b"], [F.asc(key)], n)
    names = both.groupBy("a", "b").agg(F.sort_array(F.collect_list(key)).alias("shared_entities"))
    return pairs.join(names, ["a", "b"])


def _as_candidates(pairs: DataFrame, method: str, *extra: str) -> DataFrame:
    return pairs.select(
        F.col("a").alias("paper_a_id"), F.col("b").alias("paper_b_id"), "shared_entities",
        F.col("shared_count").cast("long").alias("shared_count"), F.lit(method).alias("discovery_method"),
        *extra)


def _top_pairs(pairs: DataFrame, limit: int) -> DataFrame:
    return cap(pairs, [F.desc("shared_count"), F.asc("a"), F.asc("b")], limit)


def shared_entity_pairs(pe: DataFrame, min_shared: int = 2, limit: int = 500, key: str = "entity",
                        method: str = "shared_entities") -> DataFrame:
    """Papers with at least ``min_shared`` entities in common."""
    df = pe.select("paper_id", key).distinct()
    top = top_shared(df, key, "paper_id", min_shared, limit)
    return _as_candidates(shared_names(top, df, key, "paper_id"), method)


def method_pairs(pm: DataFrame, min_shared: int = 2, limit: int = 200) -> DataFrame:
    """Papers with at least ``min_shared`` methods in common."""
    return shared_entity_pairs(pm, min_shared, limit, "method", "methodological_parallels")


def convergent_claim_pairs(claims: DataFrame, limit: int = 300) -> DataFrame:
    """Papers with most claims of types they share; plain descriptions do not count.

    Papers are grouped by their set of types. For two sets, the total of a pair is what each paper
    has of the types that both sets share, so only the first papers of either set matter, and a
    pair of sets is opened only if its best possible total reaches the limit-th best total of a
    first probe (pairs of the papers with most claims). Papers that cannot reach it even with the
    largest paper are left aside first, and of papers with equal counts the first ``limit`` + 1 ids
    are enough. Any number of types; nothing is cut.
    """
    papers = cut_lineage(
        claims.filter(F.col("claim_type") != "descriptive")
        .groupBy("paper_id", "claim_type").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("claim_type", "n"))).alias("counts"))
        .select("paper_id", "counts", F.transform("counts", lambda c: c["claim_type"]).alias("own"),
                F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("all")))
    of = lambda counts, types: F.aggregate(
        F.filter(counts, lambda c: F.array_contains(types, c["claim_type"])), F.lit(0).cast("long"), lambda s, c: s + c["n"])

    first = cap(papers, [F.desc("all"), F.asc("paper_id")], math.isqrt(2 * limit) + 2)
    x = first.select(F.col("paper_id").alias("pa"), F.col("counts").alias("ca"), F.explode("own").alias("t"))
    y = first.select(F.col("paper_id").alias("pb"), F.col("counts").alias("cb"), F.explode("own").alias("t"))
    probe = x.join(y, "t").filter(F.col("pa") < F.col("pb")).groupBy("pa", "pb", "ca", "cb").agg(F.collect_list("t").alias("ts"))
    totals = cap(probe.select((of(F.col("ca"), F.col("ts")) + of(F.col("cb"), F.col("ts"))).alias("total")), [F.desc("total")], limit)
    seen = totals.agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).head()
    least = seen.least if seen.n >= limit else 1
    largest = first.agg(F.max("all")).head()[0] or 0
    able = top_per(papers.filter(F.col("all") + largest >= least), "counts", [F.asc("paper_id")], limit + 1)
    papers = cut_lineage(able)

    most = papers.select("own", F.explode("counts").alias("c")).groupBy("own", F.col("c.claim_type").alias("t")).agg(F.max("c.n").alias("m"))
    sets = most.join(
        most.select(F.col("own").alias("own2"), "t", F.col("m").alias("m2")), "t").filter(F.col("own") <= F.col("own2"))
    wanted = cut_lineage(
        sets.groupBy("own", "own2").agg(F.sort_array(F.collect_list("t")).alias("types"), F.sum(F.col("m") + F.col("m2")).alias("bound"))
        .filter(F.col("bound") >= least))
    views = wanted.select("own", "types").unionByName(wanted.select(F.col("own2").alias("own"), "types")).distinct()
    w = Window.partitionBy("own", "types").orderBy(F.desc("n"), F.asc("paper_id"))
    best = papers.join(views, "own").select("own", "types", "paper_id", of(F.col("counts"), F.col("types")).alias("n")).withColumn(
        "r", F.row_number().over(w)).filter(F.col("r") <= limit + 1)
    a = best.select("own", "types", F.col("paper_id").alias("pa"), F.col("n").alias("na"), F.col("r").alias("ra"))
    b = best.select(F.col("own").alias("own2"), "types", F.col("paper_id").alias("pb"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    # Of one set, a pair ranked (i, j) comes after i*j - i*(i+1)/2 - 1 pairs at least; of two sets, after i*j - 1.
    same = F.col("own") == F.col("own2")
    ahead = F.col("ra") * F.col("rb") - F.when(same, F.col("ra") * (F.col("ra") + 1) / 2).otherwise(0) - 1
    pairs = wanted.join(a, ["own", "types"]).join(b, ["own2", "types"]).filter(
        (~same | (F.col("ra") < F.col("rb"))) & (ahead < limit)
    ).select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), (F.col("na") + F.col("nb")).alias("shared_count"),
             F.array_min("types").alias("claim_type"))
    return _as_candidates(
        _top_pairs(pairs, limit).withColumn("shared_entities", F.array().cast("array<string>")), "convergent_claims", "claim_type")


def _mechanism_scores(mechs: DataFrame, fields, block: int) -> DataFrame:
    """Matching mechanism pairs per paper pair, by counts per key (inclusion-exclusion).

    Mechanisms match when any of ``fields`` agrees. Per paper and field combination the number
    of mechanisms with each value is counted first; a pair's matches are then a signed sum of
    products of those counts, so mechanisms are never paired one by one.
    """
    combos = [[f for i, f in enumerate(fields) if s >> i & 1] for s in range(1, 1 << len(fields))]
    keyed = mechs.select("paper_id", F.explode(F.array_compact(F.array(*[
        F.when(
            F.concat(*[F.col(f) for f in fs]).isNotNull(),
            F.struct(F.lit("+".join(fs)).alias("kind"), F.concat_ws("\u0001", *fs).alias("value"),
                     F.lit(1 if len(fs) % 2 else -1).alias("sign")),
        ) for fs in combos
    ]))).alias("k")).select("paper_id", "k.kind", "k.value", "k.sign")
    counts = keyed.groupBy("kind", "value", "sign", "paper_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = key_pairs(counts, ["kind", "value", "sign"], "paper_id", carry=("n",), block=block)
    return pairs.groupBy("a", "b").agg(
        F.sum(F.col("sign") * F.col("n_a") * F.col("n_b")).alias("shared_count"))


def _maybe_twice(mechs: DataFrame, fields, block: int) -> DataFrame:
    """(a, b): at least all pairs of papers that may have two matches or more.

    Such a pair agrees in two values, or in one that a paper has twice. Each paper takes the hashes of its values to where it
    meets others on one of them, so pairs that agree in a single value are dropped there. Papers with equal hashes, thus
    with any repeated value, and papers with many values keep all their pairs.
    """
    values = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.hash(F.lit(f), F.col(f))) for f in fields]))
    per = mechs.select("paper_id", values.alias("v")).groupBy("paper_id").agg(F.flatten(F.collect_list("v")).alias("v"))
    plain = (F.size("v") <= CARRIED) & (F.size("v") == F.size(F.array_distinct("v")))
    rows = per.select("paper_id", F.when(plain, F.col("v")).alias("own"), F.explode(F.array_distinct("v")).alias("k"))
    met = key_pairs(rows, "k", "paper_id", carry=("own",), block=block)
    return met.filter(F.coalesce(F.size(F.array_intersect("own_a", "own_b")) > 1, F.lit(True))).select("a", "b").distinct()


def _matches(pairs: DataFrame, mechs: DataFrame, fields) -> DataFrame:
    """Pairs of papers with how many of their mechanism pairs agree in any of ``fields``."""
    sides = [mechs.select(F.col("paper_id").alias(s), *[F.col(f).alias(f"{f}_{s}") for f in fields]) for s in ("a", "b")]
    same = F.lit(False)
    for f in fields:
        same = same | F.coalesce(F.col(f"{f}_a") == F.col(f"{f}_b"), F.lit(False))
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(same).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared_count"))


def _top_mechanism_pairs(mechs: DataFrame, fields, limit: int, block: int) -> DataFrame:
    """The ``limit`` pairs with most matches. Those with two or more are looked for first; only if they leave the limit open are all counted."""
    scores = _matches(_maybe_twice(mechs, fields, block), mechs, fields).filter(F.col("shared_count") > 1)
    top = cut_lineage(_top_pairs(scores, limit))
    return top if has_rows(top, limit) else cut_lineage(_top_pairs(_mechanism_scores(mechs, fields, block), limit))


def _top_by_verbs(mechs: DataFrame, limit: int, block: int) -> tuple[DataFrame, DataFrame, float, int]:
    """Matches in the interaction alone: (papers with the square of their counts, the ``limit`` best pairs, largest square, least count).

    Papers with equal numbers of mechanisms for each verb are one class, and the matches of two papers are the product of
    their classes' counts, so classes meet, not papers. A probe of the classes with the largest squares bounds the wanted
    minimum from below; a class whose square cannot reach it with the largest one is left aside. Classes are known by their
    first paper. The least count is 1 where the limit stays open.
    """
    per = mechs.filter(F.col("act").isNotNull()).repartition("paper_id").groupBy("paper_id", "act").agg(F.count(F.lit(1)).alias("n"))
    papers = cut_lineage(per.groupBy("paper_id").agg(
        F.sort_array(F.collect_list(F.struct("act", "n"))).alias("counts"), F.sum(F.col("n") * F.col("n")).alias("square")))
    classes = cut_lineage(papers.groupBy("counts").agg(
        F.min("paper_id").alias("cls"), F.first("square").alias("square"), F.count(F.lit(1)).alias("papers")))
    largest = float(classes.agg(F.max("square")).head()[0] or 0)

    def scored(some: DataFrame) -> DataFrame:
        verbs = some.select("cls", F.explode("counts").alias("c")).select("cls", F.col("c.act").alias("act"), F.col("c.n").alias("n"))
        met = key_pairs(verbs, "act", "cls", carry=("n",), block=block).groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("score"))
        both = met.unionByName(some.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.col("square").alias("score")))
        for x in ("a", "b"):
            both = both.join(some.select(F.col("cls").alias(x), F.col("papers").alias(f"p{x}")), x)
        made = F.when(F.col("a") == F.col("b"), F.col("pa") * (F.col("pa") - 1) / 2).otherwise(F.col("pa") * F.col("pb"))
        return both.withColumn("made", made).filter("made > 0").select("a", "b", "score", "made")

    def last(found: DataFrame) -> int:
        made = 0.0
        for row in cap(found, [F.desc("score")], limit).select("score", "made").collect():  # each makes a pair at least
            made += row.made
            if made >= limit:
                return row.score
        return 1
    least = last(scored(cap(classes, [F.desc("square"), F.asc("cls")], 10 * (math.isqrt(2 * limit) + 2))))
    able = classes.filter(F.col("square") * largest >= float(least) ** 2)
    wanted = cut_lineage(scored(able).filter(F.col("score") >= least))
    least = last(wanted)
    w = Window.partitionBy("cls").orderBy("paper_id")
    best = papers.select("paper_id", "counts").join(able.select("counts", "cls"), "counts").select(
        "cls", "paper_id", F.row_number().over(w).alias("r")).filter(F.col("r") <= limit + 1)
    side = lambda x: best.select(F.col("cls").alias(x), F.col("paper_id").alias(f"p{x}"), F.col("r").alias(f"r{x}"))
    # Of one class, a pair ranked (i, j) comes after i*j - i*(i+1)/2 - 1 pairs at least; of two classes, after i*j - 1.
    same = F.col("a") == F.col("b")
    ahead = F.col("ra") * F.col("rb") - F.when(same, F.col("ra") * (F.col("ra") + 1) / 2).otherwise(0) - 1
    pairs = wanted.filter(F.col("score") >= least).join(side("a"), "a").join(side("b"), "b").filter(
        (~same | (F.col("ra") < F.col("rb"))) & (ahead < limit)
    ).select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), F.col("score").alias("shared_count"))
    return papers.select("paper_id", "square"), cut_lineage(_top_pairs(pairs, limit)), largest, least


def _pairs_by_ends(mechs: DataFrame, squares: DataFrame, largest: float, least: int, block: int) -> DataFrame:
    """(a, b): all pairs of papers that agree in an end and may have ``least`` matches in an end or the interaction.

    Matches in the interaction are at most the root of both squares' product, those in an end at most the products of what
    both papers have of a value. Papers that cannot reach the least with any other do not meet, pairs that cannot are
    dropped where they meet.
    """
    ends = mechs.select("paper_id", F.explode(F.array_compact(F.array(*[
        F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("kind"), F.col(f).alias("value"))) for f in ("up", "down")]))).alias("e"))
    counts = ends.groupBy("e.kind", "e.value", "paper_id").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("kind", "value").agg(F.max("n").alias("most")).filter(F.col("most") > 1)
    reach = counts.join(most, ["kind", "value"], "left").groupBy("paper_id").agg(F.sum(F.col("n") * F.coalesce("most", F.lit(1))).alias("reach"))
    enough = lambda square, n: F.sqrt(square) + n >= least - 1e-6
    able = reach.join(squares, "paper_id", "left").withColumn("square", F.coalesce("square", F.lit(0)).cast("double")).filter(
        enough(F.col("square") * largest, F.col("reach")))
    met = key_pairs(counts.join(cut_lineage(able), "paper_id"), ["kind", "value"], "paper_id", carry=("n", "square", "reach"), block=block)
    both = F.col("square_a") * F.col("square_b")
    return met.filter(enough(both, F.least("reach_a", "reach_b"))).groupBy("a", "b").agg(
        F.sum(F.col("n_a") * F.col("n_b")).alias("n"), F.first(both).alias("both")).filter(enough(F.col("both"), F.col("n"))).select("a", "b")


def shared_mechanism_pairs(mechs: DataFrame, limit: int = 300, match_interaction: bool = True,
                           block: int = BLOCK) -> DataFrame:
    """Papers with most mechanism pairs that agree in an end or in the interaction.

    Interaction verbs alone link almost every paper to every other, so the best pairs by the interaction alone are found
    by classes of papers; they bound the wanted minimum from below. Of the other pairs only those that agree in an end
    can have more, and of these only such that may reach the minimum are counted. The result is exact.
    """
    low = lambda c: F.lower(F.trim(c))
    m = mechs.select("paper_id", low("upstream_entity").alias("up"), low("downstream_entity").alias("down"),
                     low("interaction_type").alias("act"),
                     F.coalesce("upstream_entity", "downstream_entity").alias("name"))
    fields = ("up", "down", "act") if match_interaction else ("up", "down")
    if not match_interaction:
        top = _top_mechanism_pairs(m, fields, limit, block)
    else:
        squares, by_verbs, largest, least = _top_by_verbs(m, limit, block)
        if least == 1:  # few verbs in common: the ends alone may bound the minimum
            by_ends = _top_mechanism_pairs(m, ("up", "down"), limit, block).agg(F.count(F.lit(1)).alias("n"), F.min("shared_count").alias("least")).head()
            least = by_ends.least if by_ends.n >= limit else 1
        counted = _matches(_pairs_by_ends(m, squares, largest, least, block), m, fields)
        found = by_verbs.unionByName(counted).groupBy("a", "b").agg(F.max("shared_count").alias("shared_count"))
        top = cut_lineage(_top_pairs(found, limit))
    x = m.select(F.col("paper_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("up", "down", "act", "name")])
    y = m.select(F.col("paper_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("up", "down", "act")])
    same = F.coalesce(F.col("up_a") == F.col("up_b"), F.lit(False))
    for f in fields[1:]:
        same = same | F.coalesce(F.col(f"{f}_a") == F.col(f"{f}_b"), F.lit(False))
    names = (
        top.join(x, "a").join(y, "b").filter(same).groupBy("a", "b")
        .agg(F.sort_array(F.collect_set("name_a")).alias("shared_entities"))
    )
    return _as_candidates(top.join(names, ["a", "b"]), "shared_mechanisms")


def merge_candidates(*dfs: DataFrame) -> DataFrame:
    """One row per pair: the largest count with its names, and all methods that found it."""
    fields = ("paper_a_id", "paper_b_id", "shared_entities", "shared_count", "discovery_method")
    rows = union_sources(*[d.select(*fields) for d in dfs])
    return rows.groupBy("paper_a_id", "paper_b_id").agg(
        F.max("shared_count").alias("shared_count"),
        F.max_by("shared_entities", F.struct("shared_count", "discovery_method")).alias("shared_entities"),
        F.array_join(F.sort_array(F.collect_set("discovery_method")), ",").alias("discovery_method"),
    )


def top_candidates(cands: DataFrame, papers: DataFrame, limit: int = 50) -> DataFrame:
    """The strongest candidates whose papers both have titles."""
    titled = papers.filter(F.length("title") > 0)
    top = cap(cands, [F.desc("shared_count"), F.asc("paper_a_id"), F.asc("paper_b_id")], limit)
    return with_titles(top, titled)


def _same_source(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    src = F.coalesce("source", F.lit("unknown"))
    for s in ("a", "b"):
        pairs = pairs.join(papers.select(F.col("paper_id").alias(s), src.alias(f"_s{s}")), s)
    return pairs.withColumn("same_source", F.col("_sa") == F.col("_sb")).drop("_sa", "_sb")


def _usable_entities(pe: DataFrame) -> DataFrame:
    return pe.select("paper_id", F.lower(F.trim("entity")).alias("entity")).filter(
        F.length("entity") > 2).distinct()


def cooccurrence(pe, papers, existing, df_cap=200, same=3, cross=3) -> DataFrame:
    """New connections between papers that share entities neither rare nor too common."""
    df = _usable_entities(pe)
    counted = shared_counts(df, "entity", "paper_id", min(same, cross), df_cap)
    fit = _same_source(counted, papers).filter(
        F.col("shared_count") >= F.when(F.col("same_source"), same).otherwise(cross))
    new = exclude_pairs(fit.withColumnsRenamed({"a": "paper_a_id", "b": "paper_b_id"}), existing,
                        "entity_cooccurrence").withColumnsRenamed({"paper_a_id": "a", "paper_b_id": "b"})
    sizes = df.groupBy("entity").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n").between(2, df_cap))
    named = shared_names(new, df.join(sizes, "entity", "left_semi"), "entity", "paper_id", 5)
    n = F.col("shared_count")
    return named.select(
        F.col("a").alias("paper_a_id"), F.col("b").alias("paper_b_id"),
        F.lit("entity_cooccurrence").alias("connection_type"),
        F.concat(F.lit("Papers share "), n.cast("string"), F.lit(" entities: "),
                 F.array_join("shared_entities", ", ")).alias("description"),
        F.least(n / 10.0, F.lit(1.0)).alias("confidence"),
        F.when(F.col("same_source"), 0.15).otherwise(0.30).alias("novelty_score"),
    )


def cooccurrence_boost(pe, papers, existing, df_cap=500, same=5, cross=3, max_new=5000) -> DataFrame:
    """The strongest new pairs, whatever connection type would already join them."""
    df = _usable_entities(pe)
    counted = shared_counts(df, "entity", "paper_id", min(same, cross), df_cap)
    fit = _same_source(counted, papers).filter(
        F.col("shared_count") >= F.when(F.col("same_source"), same).otherwise(cross))
    new = exclude_pairs(fit.withColumnsRenamed({"a": "paper_a_id", "b": "paper_b_id"}), existing)
    top = _top_pairs(new.withColumnsRenamed({"paper_a_id": "a", "paper_b_id": "b"}), max_new)
    named = shared_names(top, df, "entity", "paper_id", 5)
    n, names = F.col("shared_count"), F.col("shared_entities")
    return named.select(
        F.col("a").alias("paper_a_id"), F.col("b").alias("paper_b_id"),
        F.lit("convergent_evidence").alias("connection_type"),
        F.concat(F.lit("Entity co-occurrence: "), n.cast("string"), F.lit(" shared concepts including "),
                 F.array_join(F.slice(names, 1, 3), ", "),
                 F.when(F.size(names) > 3, "...").otherwise(".")).alias("description"),
        F.round(F.least(F.lit(0.95), 0.5 + n * 0.05), 3).alias("confidence"),
        F.when(F.col("same_source"), 0.1).otherwise(0.3).alias("novelty_score"),
    )


def drop_type(conns: DataFrame, t: str = "replicates") -> DataFrame:
    """G17."""
    return conns.filter(F.col("connection_type") != t)


def papers_sharing(paper_id, pe: DataFrame, k: int = 20) -> DataFrame:
    """Papers that share most entities with one paper."""
    df = pe.select("paper_id", "entity").distinct()
    own = df.filter(F.col("paper_id") == paper_id).select("entity")
    return cap(
        df.filter(F.col("paper_id") != paper_id).join(own, "entity", "left_semi")
        .groupBy("paper_id").agg(F.count(F.lit(1)).alias("shared")),
        [F.desc("shared"), F.asc("paper_id")], k)


# --- vectors ---------------------------------------------------------------------------------

PLACED = 256  # rows of a batch that are copied to the cells they visit at once
AT_ONCE = 128  # rows of a block that are multiplied at once
STEPS = (0.9, 0.8, 0.7, 0.6, 0.5)  # similarities down which the approximate search goes


def measured_vectors(vecs: DataFrame, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """(id, v, len): vectors as they are, floats or else doubles, and their lengths; those without one are left out."""
    kind = "array<float>" if vecs.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = vecs.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("v"))
    length = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return v.withColumn("len", length).filter(F.col("len") > 0)


def _units(pdf: pd.DataFrame) -> np.ndarray:
    """Unit vectors of rows of ``measured_vectors``, as doubles."""
    return np.stack(pdf["v"].to_list()).astype("float64") / pdf["len"].to_numpy()[:, None]


def similar_pairs(vecs: DataFrame, threshold=0.75, limit: int | None = 500, id_col="vec_id", vec_col="embedding",
                  pivots=64, block: int | None = None) -> DataFrame:
    """The ``limit`` most similar pairs with cosine at least ``threshold``, or all of them for None; exact.

    Vectors go to the cell of their nearest pivot. By the triangle inequality of angles a partner
    within angle t lies in a cell whose pivot is at most 2t farther than the own one, so a vector
    also visits only such cells, and only later-numbered ones. Cells are cut into blocks of about
    ``block`` residents (unset: 6000, or 2000 without a limit); a task multiplies one pair of blocks and passes
    on its own best ``limit`` pairs, which is all the overall best can need. Without a limit it passes on all of its
    pairs. Rows are placed few at a time, as each may visit all cells.
    """
    block = block or (2000 if limit is None else 6000)
    units = cut_lineage(measured_vectors(vecs, id_col, vec_col))
    picked = units.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not picked:
        return units.select(F.col("id").alias("paper_a_id"), F.col("id").alias("paper_b_id"),
                            F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("shared_count"),
                            F.lit("").alias("discovery_method"))
    centres = np.array([r.v for r in picked]) / np.array([r.len for r in picked])[:, None]
    reach = 2 * math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    id_type = units.schema["id"].dataType.simpleString()

    def place(batches):
        for pdf in (b.iloc[at:at + PLACED] for b in batches for at in range(0, len(b), PLACED)):
            angle = np.arccos(np.clip(_units(pdf) @ centres.T, -1.0, 1.0))
            home = angle.argmin(axis=1)
            near = angle <= angle[np.arange(len(pdf)), home][:, None] + reach
            later = np.arange(centres.shape[0])[None, :] > home[:, None]
            visit = near & later
            visit[np.arange(len(pdf)), home] = True
            row, cell = np.nonzero(visit)
            out = pdf.iloc[row].reset_index(drop=True)
            out["cell"] = cell.astype("int32")
            out["home"] = cell == home[row]
            yield out

    placed = units.mapInPandas(place, f"{units.schema.simpleString()[7:-1]}, cell int, home boolean")
    sizes = units.mapInPandas(
        lambda batches: (p[["cell", "home"]] for p in place(batches)), "cell int, home boolean"
    ).groupBy("cell", "home").count().collect()
    per_cell = lambda home: F.coalesce(F.try_element_at(F.create_map(
        F.lit(-1), F.lit(0),
        *[F.lit(x) for r in sizes if r["home"] == home for x in (r["cell"], -(-r["count"] // block))],
    ), F.col("cell")), F.lit(0))
    # Residents of block p meet block q (p <= q); visitors meet every block of residents.
    own = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    met = (
        placed.withColumn("nb", per_cell(True)).withColumn("ng", per_cell(False)).filter(F.col("nb") > 0)
        .withColumn("p", F.when(F.col("home"), own))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("lo", F.when(F.col("home"), F.least("p", "q")).otherwise(F.col("q")))
        .withColumn("hi", F.when(F.col("home"), F.greatest("p", "q")).otherwise(F.col("q")))
        # Visitors of a cell are dealt to groups too, so that a popular cell is many tasks.
        .withColumn("guest", F.when(~F.col("home"), F.pmod(F.xxhash64("id"), F.col("ng")).cast("int")))
    )
    residents = met.filter("home").select("id", "v", "len", "home", "p", "cell", "lo", "hi", F.lit(-1).alias("guest"))
    guests = met.filter(~F.col("home")).select("id", "v", "len", "home", F.lit(-1).alias("p"), "cell", "lo", "hi", "guest")
    hosts = (
        met.filter(F.col("home") & (F.col("lo") == F.col("hi")))
        .filter(F.col("ng") > 0)
        .select("id", "v", "len", "home", "p", "cell", "lo", "hi",
                F.explode(F.sequence(F.lit(0), F.col("ng") - 1)).alias("guest"))
    )

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf[pdf["home"]]
        meets_guests = pdf["guest"].iloc[0] >= 0
        other = pdf[~pdf["home"]] if meets_guests else r
        if not len(r) or not len(other):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        best = []
        right = _units(r)
        rid, rp = r["id"].to_numpy(), r["p"].to_numpy()
        oid, op = other["id"].to_numpy(), other["p"].to_numpy()
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        for at in range(0, len(other), AT_ONCE):
            sim = _units(other.iloc[at:at + AT_ONCE]) @ right.T
            i, j = np.nonzero(sim >= threshold - 1e-9)
            s = sim[i, j]
            x, y = oid[at + i], rid[j]
            ok = np.ones(len(i), bool) if meets_guests else x < y
            if not meets_guests and lo != hi:
                ok &= op[at + i] != rp[j]
            part = pd.DataFrame({"a": np.minimum(x, y)[ok], "b": np.maximum(x, y)[ok], "similarity": s[ok]})
            best.append(part)
            if limit is not None and sum(map(len, best)) > 4 * limit:
                best = [_best(pd.concat(best), limit)]
        return _best(pd.concat(best), limit) if best else pd.DataFrame({"a": [], "b": [], "similarity": []})

    rows = residents.unionByName(guests).unionByName(hosts).repartition("cell", "lo", "hi", "guest")
    near = rows.groupBy("cell", "lo", "hi", "guest").applyInPandas(match, f"a {id_type}, b {id_type}, similarity double")
    found = cap(near, [F.desc("similarity"), F.asc("a"), F.asc("b")], limit)
    return found.filter(F.col("similarity") >= threshold).select(
        F.col("a").alias("paper_a_id"), F.col("b").alias("paper_b_id"), "similarity",
        F.rint(F.col("similarity") * 10).cast("long").alias("shared_count"),
        F.lit("embedding_similarity").alias("discovery_method"))


def _best(pdf: pd.DataFrame, limit: int | None) -> pd.DataFrame:
    return pdf if limit is None else pdf.sort_values(["similarity", "a", "b"], ascending=[False, True, True]).head(limit)


def meeting_chance(bits: int, threshold: float, draws: int = 50_000) -> float:
    """With which probability a pair just at the threshold meets in one table, by draws; less two standard errors.

    A pair meets if the codes are equal, or differ in one bit alone that is the least certain one of either.
    """
    rng = np.random.default_rng(7)
    c = max(-1.0, min(1.0, threshold))
    x, z = rng.standard_normal((2, draws, bits))
    y = c * x + math.sqrt(1 - c * c) * z
    differs = (x > 0) != (y > 0)
    n, at = differs.sum(axis=1), differs.argmax(axis=1)
    meets = (n == 0) | ((n == 1) & ((np.abs(x).argmin(axis=1) == at) | (np.abs(y).argmin(axis=1) == at)))
    p = float(meets.mean())
    return max(p - 2 * math.sqrt(p * (1 - p) / draws), (1 - math.acos(c) / math.pi) ** bits)


def code_tables(n: int, width: int, threshold: float, recall: float = 0.97, bucket: int = 2000, seed: int = 42) -> np.ndarray:
    """Random hyperplanes (table, bit, dimension): so many bits that buckets hold about ``bucket`` of ``n`` vectors, and so
    many tables that a pair just at the threshold meets in one with the probability ``recall``. A lower threshold adds
    tables to those of a higher one."""
    bits = min(max(math.ceil(math.log2(max(n, 2) / bucket)), 1), 24)
    chance = meeting_chance(bits, threshold)
    tables = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log1p(-chance))
    return np.random.default_rng(seed).standard_normal((tables, bits, width))


def similar_pairs_lsh(vecs: DataFrame, threshold=0.75, limit: int | None = 500, id_col="vec_id", vec_col="embedding",
                      block: int | None = None) -> DataFrame:
    """X01, approximate: pairs that share a code of signed random hyperplanes, then the exact cosine.

    A code is the sides on which a vector lies of a table's hyperplanes. A vector also visits the bucket of the code with
    its least certain bit turned over (multi-probe); a pair meets if either of the two is at home. Vectors travel once or
    twice a table, so buckets are as large as a task multiplies at once, which needs few tables. Buckets over ``block``
    vectors (unset: 4000, or 1000 without a limit) are dealt to blocks and each two blocks meet in a group of their own.

    Close pairs need few tables: with a limit, pairs from STEPS downwards are looked for, each step adds the tables that its
    threshold needs, and the search ends at the step that fills the limit. Sparse pairs at a low ``threshold`` need all
    tables, whose number grows with the vectors to a power under one.
    """
    block = block or (1000 if limit is None else 4000)
    units = cut_lineage(measured_vectors(vecs, id_col, vec_col))
    id_type = units.schema["id"].dataType.simpleString()
    n, width = units.select(F.count("*"), F.max(F.size("v"))).first()
    own_fields = units.schema.simpleString()[7:-1]
    order = [F.desc("similarity"), F.asc("paper_a_id"), F.asc("paper_b_id")]

    def meeting(planes: np.ndarray) -> DataFrame:
        bits = planes.shape[1]

        def codes(pdf):
            v = _units(pdf)
            for t, own in enumerate(planes):
                side = v @ own.T
                code = (side > 0) @ (1 << np.arange(bits))
                probe = code ^ (1 << np.abs(side).argmin(axis=1))
                yield from ((t, True, code), (t, False, probe))

        def place(batches):
            for part in (b.iloc[at:at + 1000] for b in batches for at in range(0, len(b), 1000)):
                for t, home, code in codes(part):
                    yield part.assign(t=np.int32(t), code=code.astype("int64"), home=home)

        def tally(batches):
            for part in (b.iloc[at:at + 1000] for b in batches for at in range(0, len(b), 1000)):
                for t, _, code in codes(part):
                    key, count = np.unique(code, return_counts=True)
                    yield pd.DataFrame({"t": np.int32(t), "code": key.astype("int64"), "n": count.astype("int64")})

        placed = units.mapInPandas(place, f"{own_fields}, t int, code bigint, home boolean")
        large = units.mapInPandas(tally, "t int, code bigint, n bigint").groupBy("t", "code").agg(F.sum("n").alias("n")).filter(
            F.col("n") > block).select("t", "code", F.ceil(F.col("n") / block).cast("int").alias("nb"))
        own = F.coalesce(F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"), F.lit(0))
        met = (
            placed.join(F.broadcast(cut_lineage(large)), ["t", "code"], "left").withColumn("p", own)
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1)))
            .select("id", "v", "len", "home", "p", "t", "code", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")))

        def match(pdf: pd.DataFrame) -> pd.DataFrame:
            v, ids, home, p = _units(pdf), pdf["id"].to_numpy(), pdf["home"].to_numpy(), pdf["p"].to_numpy()
            across = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
            found, least = [], threshold
            for at in range(0, len(v), AT_ONCE):
                i, j = np.nonzero(v[at:at + AT_ONCE] @ v.T >= least - 1e-9)
                i = i + at
                ok = (ids[i] < ids[j]) & (home[i] | home[j]) & ((p[i] != p[j]) if across else True)
                i, j = i[ok], j[ok]
                cosines = [(v[i[k:k + 65536]] * v[j[k:k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)]
                found.append(pd.DataFrame({"a": ids[i], "b": ids[j], "similarity": np.concatenate([*cosines, np.zeros(0)])}))
                if limit is not None and sum(map(len, found)) > 4 * limit:
                    found = [_best(pd.concat(found), limit)]
                    least = max(least, found[0]["similarity"].min())
            return _best(pd.concat(found), limit)

        near = met.groupBy("t", "code", "lo", "hi").applyInPandas(match, f"a {id_type}, b {id_type}, similarity double")
        return near.select(F.col("a").alias("paper_a_id"), F.col("b").alias("paper_b_id"), "similarity").filter(
            F.col("similarity") >= threshold)

    found, made = None, 0
    for least in ([s for s in STEPS if s > threshold] if limit is not None and n else []) + [threshold]:
        planes = code_tables(n, width or 0, least, bucket=max(block // 2, 1))
        if len(planes) > made or found is None:
            near = meeting(planes[made:])
            near = near if found is None else near.unionByName(found)
            pairs = near.groupBy("paper_a_id", "paper_b_id").agg(F.max("similarity").alias("similarity"))
            found, made = cut_lineage(pairs if limit is None else cap(pairs, order, limit)), len(planes)
        if limit is not None and has_rows(found.filter(F.col("similarity") >= least), limit):
            break
    return found if limit is None else cap(found, order, limit)


def similar_to(vecs: DataFrame, query_id, k=20, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """The ``k`` vectors nearest to one vector; a scan with the query as a literal."""
    row = vecs.filter((F.col(id_col) == query_id) & F.col(vec_col).isNotNull()).select(vec_col).head()
    if row is None:
        return vecs.limit(0).select(F.col(id_col).alias("paper_id"), F.lit(0.0).alias("similarity"))
    query = F.lit([float(x) for x in row[0]])
    return cap(
        vecs.filter((F.col(id_col) != query_id) & F.col(vec_col).isNotNull())
        .select(F.col(id_col).alias("paper_id"), cosine(F.col(vec_col), query).alias("similarity")),
        [F.desc("similarity"), F.asc("paper_id")], k)
