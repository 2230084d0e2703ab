"""Path discovery and graph neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from litgraph.functions.scores import crossings, distinct_known, geomean, sigmoid
from litgraph.functions.text import any_of, contains_ci
from litgraph.operators.joins import (
    alias_keys, cap, half_edges, induced_links, latest_per, no_edge_either_way, top_per,
)
from litgraph.operators.pairs import key_pairs
from litgraph.operators.worksets import degree
from litgraph.runtime import cut_lineage, has_rows


def resolve_seeds(seeds: DataFrame, entities: DataFrame, edges: DataFrame, discovered: DataFrame) -> DataFrame:
    """Canonical names of seeds; else the seed itself if edges or discovered entities know it."""
    asked = seeds.select("seed").distinct().withColumn("key", F.lower(F.trim("seed")))
    names = alias_keys(entities).select("key", "canonical_name").distinct()
    canonical = asked.join(names, "key").select(F.col("canonical_name").alias("resolved_name"))
    rest = asked.join(names.select("key").distinct(), "key", "left_anti")
    ends = edges.select(F.explode(F.array(
        F.lower("source_entity_name"), F.lower("target_entity_name"))).alias("key"))
    found = discovered.select(F.lower("canonical_text").alias("key"))
    other = rest.join(ends.unionByName(found), "key", "left_semi").select(F.col("seed").alias("resolved_name"))
    return canonical.unionByName(other).distinct()


def _edge_steps(edges: DataFrame) -> DataFrame:
    """Edges as steps between lower-cased names; self-loops never lie on a simple path."""
    return edges.select(
        F.lower("source_entity_name").alias("from_key"), F.lower("target_entity_name").alias("to_key"),
        F.col("source_entity_name").alias("from_name"), F.col("target_entity_name").alias("to_name"),
        F.col("predicate_type").alias("pred"), F.col("source_operation").alias("from_op"),
        F.col("target_operation").alias("to_op"), F.col("edge_source").alias("src"),
        F.col("support_count").alias("support"),
        F.coalesce(F.col("mean_confidence").cast("double"), F.lit(0.5)).alias("conf"),
        F.col("contradiction_load").cast("long").alias("contra"),
    ).filter(F.col("from_key") != F.col("to_key"))


def _start(steps: DataFrame, carry) -> DataFrame:
    return steps.select(
        *carry, F.array("from_key", "to_key").alias("path_keys"), F.array("from_name", "to_name").alias("path_names"),
        F.array("pred").alias("preds"), F.array("from_op", "to_op").alias("ops"),
        F.array("src").alias("edge_sources"), F.array("support").alias("supports"),
        F.array("conf").alias("confs"), F.col("contra").alias("contra_load"), F.col("to_key").alias("last_key"),
        F.lit(1).alias("hops"),
    )


HUB_EDGES = 1000  # edges of one node in one block; a node with more has several


def in_blocks(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps with a ``block``, hubs): edges of nodes with over HUB_EDGES dealt to blocks, and how many each such node has."""
    hubs = cut_lineage(steps.groupBy(F.col("from_key").alias("hub")).count().filter(F.col("count") > HUB_EDGES).select(
        "hub", F.ceil(F.col("count") / HUB_EDGES).cast("int").alias("blocks")))
    dealt = F.pmod(F.xxhash64("to_key", "pred"), F.coalesce("blocks", F.lit(1))).cast("int")
    return steps.join(hubs, steps["from_key"] == hubs["hub"], "left").withColumn("block", dealt).drop("hub", "blocks"), hubs


def self_extend(paths: DataFrame, steps: DataFrame, carry=(), hubs: DataFrame | None = None) -> DataFrame:
    """Paths one edge longer, without coming back to a node.

    With ``hubs`` (see ``in_blocks``) a path that ends at a hub meets each block of its edges in a group of its own.
    """
    grow = lambda a, x: F.concat(F.col(a), F.array(x)).alias(a)
    on = F.col("last_key") == F.col("from_key")
    if hubs is not None:
        paths = paths.join(hubs, F.col("last_key") == F.col("hub"), "left").withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("hub", "blocks")
        on = on & (F.col("_block") == F.col("block"))
    return (
        paths.join(steps, on)
        .filter(~F.array_contains("path_keys", F.col("to_key")))
        .select(
            *carry, grow("path_keys", "to_key"), grow("path_names", "to_name"), grow("preds", "pred"),
            grow("ops", "to_op"), grow("edge_sources", "src"), grow("supports", "support"), grow("confs", "conf"),
            (F.col("contra_load") + F.col("contra")).alias("contra_load"), F.col("to_key").alias("last_key"),
            (F.col("hops") + 1).alias("hops"),
        )
    )


def _distances(steps: DataFrame, targets: DataFrame, hops: int, carry) -> DataFrame:
    """Fewest steps from each node to a target, up to ``hops`` (backward breadth-first search)."""
    back = steps.select(F.col("to_key").alias("node"), F.col("from_key").alias("prev")).distinct()
    seen = level = cut_lineage(targets.select(*carry, "node").distinct().withColumn("dist", F.lit(0)))
    for d in range(1, hops + 1):
        level = cut_lineage(
            level.join(back, "node").select(*carry, F.col("prev").alias("node")).distinct()
            .join(seen, [*carry, "node"], "left_anti").withColumn("dist", F.lit(d))
        )
        if not has_rows(level):
            break
        seen = seen.unionByName(level)
    return seen


def enumerate_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None, max_hops=4, min_hops=1,
                    path_limit: int | None = 500, min_cross_ops=0, carry=(), order=None) -> DataFrame:
    """Simple directed paths from the seeds, fewest hops and contradictions first.

    ``seeds``/``targets`` hold names in ``resolved_name`` (and the ``carry`` columns, searched
    apart). With targets, a path is followed only while a target is still in reach. Shorter paths
    come first, so a search ends after the level that fills its ``path_limit`` (each group of
    ``carry`` by itself), unless another ``order`` is asked for. Every level is written once.
    """
    carry = list(carry)
    steps = _edge_steps(edges)
    named = lambda df, key: df.select(*carry, F.lower("resolved_name").alias(key)).distinct()
    start = steps.join(named(seeds, "from_key"), "from_key")
    reach = None
    if targets is not None:
        reach = _distances(steps, named(targets, "node"), max_hops - 1, carry)
        reach = reach.withColumnRenamed("node", "last_key")
        usable = reach.select(F.col("last_key").alias("to_key")).distinct()
        steps = steps.join(usable, "to_key", "left_semi")
    steps, hubs = in_blocks(cut_lineage(steps))
    found, level = None, _start(start, carry)
    for hop in range(1, max_hops + 1):
        if hop > 1:
            level = self_extend(level, steps, carry, hubs)
        if reach is not None:
            level = level.join(reach, [*carry, "last_key"]).filter(F.col("hops") + F.col("dist") <= max_hops)
        level = level.withColumn("op_boundary_crossings", crossings(F.col("ops")))
        fit = (F.col("op_boundary_crossings") >= min_cross_ops) & (F.col("hops") >= min_hops)
        if reach is not None:
            fit = fit & (F.col("dist") == 0)
        if hop < max_hops:
            level = cut_lineage(level)
        hits = level.filter(fit).drop("dist")
        found = hits if found is None else found.unionByName(hits)
        level = level.drop("dist", "op_boundary_crossings")
        if hop < max_hops and path_limit is not None and order is None:
            if carry:
                full = found.groupBy(*carry).count().filter(F.col("count") >= path_limit).select(*carry)
                level = level.join(cut_lineage(full), carry, "left_anti")
            elif has_rows(found, path_limit):
                break
    found = found.withColumn("distinct_ops", distinct_known(F.col("ops"))).withColumn(
        "path_key", F.concat_ws("|", F.concat("path_keys", "preds", "edge_sources")))
    ranking = order or [F.asc("hops"), F.asc("contra_load"), F.asc("path_key")]
    if path_limit is None:
        return found
    best = top_per(found, carry, ranking, path_limit) if carry else cap(found, ranking, path_limit)
    # A limited result is small and read several times over (endpoints, scores, ranks).
    return cut_lineage(best)


def _prospects(steps: DataFrame, rest: int) -> list[DataFrame]:
    """For each number of steps up to ``rest``: (node, gain), the most crossings that so many steps from a node can add.

    Walks may come back to a node, so the gain of a path is never more.
    """
    crossed = F.coalesce((F.col("from_op") != F.col("to_op")).cast("int"), F.lit(0))
    moves = cut_lineage(steps.select("from_key", "to_key", crossed.alias("own")).groupBy("from_key", "to_key").agg(F.max("own").alias("own")))
    gains = []
    for _ in range(rest):
        ahead = moves if not gains else moves.join(gains[-1], F.col("to_key") == F.col("node"), "left").withColumn(
            "own", F.col("own") + F.coalesce("gain", F.lit(0)))
        gains.append(cut_lineage(ahead.groupBy(F.col("from_key").alias("node")).agg(F.max("own").alias("gain"))))
    return gains


def best_first(edges: DataFrame, seeds: DataFrame, order: list, limit: int, bound, beaten, max_hops=4, min_cross_ops=0,
               score=None) -> DataFrame:
    """The first ``limit`` simple paths from the seeds by ``order``, by branch and bound over levels.

    ``score`` adds the columns of ``order`` to whole paths. ``bound(rest)`` gives columns (name to expression over a
    partial path and ``gain``, the most crossings still possible) that no path it grows into exceeds, and
    ``beaten(worst)`` is true for partial paths that cannot come before ``worst``, the last of ``limit`` paths found so
    far. Each level keeps the best of all paths so far and only the partial ones that are not beaten.
    """
    steps = _edge_steps(edges)
    start = steps.join(seeds.select(F.lower("resolved_name").alias("from_key")).distinct(), "from_key")
    gains = _prospects(steps, max_hops - 1)
    steps, hubs = in_blocks(cut_lineage(steps))
    best, level = None, _start(start, ())
    for hop in range(1, max_hops + 1):
        if hop > 1:
            level = self_extend(level, steps, (), hubs)
        level = level.withColumn("op_boundary_crossings", crossings(F.col("ops")))
        level = cut_lineage(level) if hop < max_hops else level
        whole = level.filter(F.col("op_boundary_crossings") >= min_cross_ops).withColumn("distinct_ops", distinct_known(F.col("ops"))).withColumn(
            "path_key", F.concat_ws("|", F.concat("path_keys", "preds", "edge_sources")))
        whole = score(whole) if score else whole
        best = cut_lineage(cap(whole if best is None else best.unionByName(whole.select(*best.columns)), order, limit))
        if hop == max_hops:
            break
        rest = max_hops - hop
        ahead = level.join(gains[rest - 1].withColumnRenamed("node", "last_key"), "last_key")  # others lead nowhere
        ahead = ahead.filter(F.col("op_boundary_crossings") + F.col("gain") >= min_cross_ops)
        last = best.orderBy(*order).tail(1) if best.count() == limit else []
        if last:
            ahead = ahead.withColumns(bound(rest)).filter(~beaten(last[0]))
        level = ahead.select(*[c for c in level.columns if c != "op_boundary_crossings"])
    return best


def traverse(edges, seed, target=None, max_hops=4, limit: int | None = 100, min_cross_ops=0) -> DataFrame:
    """Paths from one seed, by operation crossings and the product of confidences.

    Without a target and with a limit only partial paths are followed that can still get among the best (``best_first``):
    crossings are bounded by what a node's surroundings allow, and confidences, which are one at most, can only fall.
    """
    spark = edges.sparkSession
    name = lambda x: spark.createDataFrame([(x,)], "resolved_name string")
    product = F.aggregate("confs", F.lit(1.0), lambda s, c: s * c)
    order = ([F.asc("hops")] if target else []) + [
        F.desc("op_boundary_crossings"), F.desc("path_conf"), F.asc("contra_load"), F.asc("path_key")]
    if target is None and limit is not None:
        surest = edges.agg(F.max(F.coalesce(F.col("mean_confidence").cast("double"), F.lit(0.5)))).first()[0] or 0.0
        grown = max(surest, 1.0)

        def beaten(worst):
            most, n = F.col("most"), worst["op_boundary_crossings"]
            return (most < n) | ((most == n) & (F.col("surely") < worst["path_conf"]))
        return best_first(
            edges, name(seed), order, limit, lambda rest: {"most": F.col("op_boundary_crossings") + F.col("gain"), "surely": product * grown**rest},
            beaten, max_hops, min_cross_ops, lambda paths: paths.withColumn("path_conf", product))
    paths = enumerate_paths(edges, name(seed), name(target) if target else None, max_hops, 1, None, min_cross_ops)
    scored = paths.withColumn("path_conf", product)
    return scored if limit is None else cap(scored, order, limit)


NOVEL = 0.8808  # novelty of ends that are never mentioned together, rounded up


def best_paths(edges, triples, seeds, limit: int = 25, max_hops=4, min_cross_ops=0) -> DataFrame:
    """D03 with W04: the best scored paths from the seeds, without scoring all of them.

    The composite of what a partial path grows into is bounded by the novelty of ends that never meet, the coherence if
    all further confidences are one and all further steps cross, the plausibility if they are curated, and the
    contradictions so far over the longest length.
    """
    def bound(rest):
        most = F.col("hops") + rest
        logs = F.aggregate("confs", F.lit(0.0), lambda s, c: s + F.log(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.01))))
        crossed = F.least(F.lit(1.0), (F.col("op_boundary_crossings") + F.col("gain")) / F.col("hops"))
        coherence = F.least(F.lit(1.0), F.exp(logs / most) * (1.0 + 0.3 * crossed))
        grounded = (F.size(F.filter("edge_sources", lambda s: s == "backbone")) + rest) / most
        against = F.least(F.lit(1.0), F.col("contra_load") / (most * 2))
        return {"most": NOVEL * coherence * (0.5 + 0.5 * grounded) / (1.0 + against)}

    def score(paths):
        paths = cut_lineage(paths)
        ends = paths.select(F.element_at("path_keys", 1).alias("endpoint_a"), F.element_at("path_keys", -1).alias("endpoint_b"))
        return score_paths(paths, co_mentions(triples, ends))
    order = [F.desc("composite"), F.asc("hops"), F.asc("path_key")]
    return best_first(edges, seeds, order, limit, bound, lambda worst: F.col("most") < worst["composite"] - 1e-4, max_hops, min_cross_ops, score)


def co_mentions(triples: DataFrame, endpoint_pairs: DataFrame) -> DataFrame:
    """Papers where one triple touches each endpoint, the two triples being different.

    Per paper and name it is enough to know how many triples touch it and, if one, which. A name in a paper meets either
    the paper's other names or the partners that the pairs give it, whichever are fewer: frequent names with many partners
    stay within their papers, papers with very many names follow the pairs. Names meet as numbers.
    """
    pairs = endpoint_pairs.select(F.lower("endpoint_a").alias("a"), F.lower("endpoint_b").alias("b")).distinct()
    ends = F.array(
        F.struct(F.col("a").alias("name"), F.col("b").isNotNull().cast("long").alias("n")),
        F.struct(F.col("b").alias("name"), F.lit(0).cast("long").alias("n")))
    names = cut_lineage(
        pairs.select(F.explode(ends).alias("e")).select("e.*").filter(F.col("name").isNotNull())
        .groupBy("name").agg(F.sum("n").alias("partners")).withColumn("id", F.monotonically_increasing_id()))
    number = lambda df, s: df.join(names.select(F.col("name").alias(s), F.col("id").alias(f"id_{s}")), s, "left")
    pairs = number(number(pairs, "a"), "b")
    of_paper = Window.partitionBy("paper_id")
    touch = cut_lineage(
        triples.filter(F.col("triple_id").isNotNull())
        .select("paper_id", "subject", "object", F.dense_rank().over(of_paper.orderBy("triple_id")).alias("triple"))
        .select("paper_id", "triple", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower("object")))).alias("name"))
        .join(names, "name")
        .repartition("paper_id")
        .groupBy("paper_id", "id", "partners")
        .agg(F.min("triple").alias("lo"), F.max("triple").alias("hi"))
        .withColumn("names", F.count(F.lit(1)).over(of_paper))
        .select("paper_id", "id", "partners", "names", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only")))
    side = lambda s: touch.select("paper_id", "partners", "names", F.col("id").alias(f"id_{s}"), F.col("only").alias(f"only_{s}"))
    first, second = side("a").filter(F.col("partners") > 0), side("b").drop("partners", "names")
    inside = first.filter(F.col("names") <= F.col("partners")).join(second, "paper_id")
    along = (
        first.filter(F.col("names") > F.col("partners"))
        .join(pairs.filter(F.col("id_b").isNotNull()).select("id_a", "id_b"), "id_a").join(second, ["paper_id", "id_b"]))
    differ = F.coalesce(F.col("only_a") != F.col("only_b"), F.lit(True))
    met = [d.filter(differ).select("id_a", "id_b") for d in (inside, along)]
    counts = met[0].unionByName(met[1]).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("co_mentions"))
    return pairs.join(counts, ["id_a", "id_b"], "left").select(
        F.col("a").alias("endpoint_a"), F.col("b").alias("endpoint_b"),
        F.coalesce("co_mentions", F.lit(0)).alias("co_mentions"))


def path_scores(paths: DataFrame) -> DataFrame:
    """Score columns of paths that carry ``co_mentions`` of their endpoints."""
    hops = F.greatest(F.col("hops"), F.lit(1))
    novelty = 1.0 - sigmoid(F.log(1.0 + F.col("co_mentions")) - 2.0)
    coherence = F.least(F.lit(1.0), geomean(F.col("confs")) * (1.0 + 0.3 * (F.col("op_boundary_crossings") / hops)))
    grounded = F.size(F.filter("edge_sources", lambda s: s == "backbone")) / F.greatest(F.size("edge_sources"), F.lit(1))
    plausibility = 0.5 + 0.5 * grounded
    contra = F.least(F.lit(1.0), F.col("contra_load") / (hops * 2))
    least = F.array_min("supports")
    return paths.withColumns({
        "_n": novelty, "_c": coherence, "_p": plausibility, "_x": contra,
        "weakest_edge_idx": (F.array_position("supports", least) - 1).cast("int"),
        "weakest_edge_support": least,
    }).withColumns({
        "novelty": F.bround("_n", 4), "coherence": F.bround("_c", 4), "plausibility": F.bround("_p", 4),
        "contradiction_load": F.bround("_x", 4),
        "composite": F.bround(F.col("_n") * F.col("_c") * F.col("_p") / (1.0 + F.col("_x")), 4),
    }).drop("_n", "_c", "_p", "_x")


def score_paths(paths: DataFrame, co: DataFrame) -> DataFrame:
    """Join the endpoint co-mentions and score."""
    keyed = paths.withColumns({
        "endpoint_a": F.element_at("path_keys", 1), "endpoint_b": F.element_at("path_keys", -1)})
    return path_scores(
        keyed.join(co, ["endpoint_a", "endpoint_b"], "left")
        .withColumn("co_mentions", F.coalesce("co_mentions", F.lit(0)))
        .drop("endpoint_a", "endpoint_b"))


def rank_paths(scored: DataFrame, run_col: str = "run_id", keep_top: int = 25) -> DataFrame:
    """The best paths of each run with their rank."""
    from pyspark.sql import Window

    w = Window.partitionBy(run_col).orderBy(F.desc("composite"), F.asc("hops"), F.asc("path_key"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep_top)


def flag_weak_edges(ranked: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Weakest edges to look up again: one paper at most, between two operations."""
    i = F.col("weakest_edge_idx")
    edges = ranked.filter(F.col("weakest_edge_support") <= 1).select(
        run_col, "rank",
        F.element_at("path_names", i + 1).alias("source_entity"), F.element_at("path_names", i + 2).alias("target_entity"),
        F.element_at("preds", i + 1).alias("predicate_type"),
        F.element_at("ops", i + 1).alias("source_op"), F.element_at("ops", i + 2).alias("target_op"),
    ).filter(F.col("source_op") != F.col("target_op"))
    keyed = edges.withColumns({"_s": F.lower("source_entity"), "_t": F.lower("target_entity")})
    return latest_per(keyed, [run_col, "_s", "_t", "predicate_type"], [F.asc("rank")]).drop("_s", "_t").withColumn(
        "detection_method", F.lit("discovery_weak_edge"))


def missing_edges(triples, entities, edges, seed=None, min_papers=2, limit: int | None = 25) -> DataFrame:
    """Entities of different operations, subjects in common papers, yet without an edge."""
    known = entities.filter(F.col("primary_operation").isNotNull()).select(
        "entity_id", "canonical_name", F.col("primary_operation").alias("op"))
    subjects = triples.select("paper_id", F.col("subject_normalized_id").alias("entity_id")).filter(
        F.col("entity_id").isNotNull()).distinct().join(known.select("entity_id", "op"), "entity_id")
    if seed is not None:
        focus = known.filter(F.lower("canonical_name") == seed.lower()).select("entity_id")
        papers = subjects.join(focus, "entity_id", "left_semi").select("paper_id").distinct()
        subjects = subjects.join(papers, "paper_id", "left_semi")
    pairs = key_pairs(subjects, "paper_id", "entity_id", carry=("op",)).filter(F.col("op_a") != F.col("op_b"))
    counted = (
        pairs.groupBy(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))
        .agg(F.count(F.lit(1)).alias("co_paper_count")).filter(F.col("co_paper_count") >= min_papers)
    )
    open_ = no_edge_either_way(counted, edges, "entity_id_a", "entity_id_b")
    for s in ("a", "b"):
        open_ = open_.join(known.select(
            F.col("entity_id").alias(f"entity_id_{s}"), F.col("canonical_name").alias(f"entity_{s}"),
            F.col("op").alias(f"op_{s}")), f"entity_id_{s}")
    if seed is not None:
        open_ = open_.filter((F.lower("entity_a") == seed.lower()) | (F.lower("entity_b") == seed.lower()))
    out = open_.select("entity_a", "op_a", "entity_b", "op_b", "co_paper_count")
    return out if limit is None else cap(out, [F.desc("co_paper_count"), F.asc("entity_a"), F.asc("entity_b")], limit)


# --- undirected graph ------------------------------------------------------------------------

def concept_nodes(nodes: DataFrame, concept: str, cols=("text",)) -> DataFrame:
    return nodes.filter(any_of([contains_ci(F.col(c), concept) for c in cols])).select("id")


def shortest_paths(nodes, edges, concept_a, concept_b, max_hops=4, limit=5) -> DataFrame:
    """The shortest undirected paths between nodes of two concepts.

    Papers are tried first, then all nodes. One search runs from all nodes of the first concept
    at once; a node keeps its ``limit`` nearest sources, which is enough for the best ``limit``
    pairs overall.
    """
    max_hops = max(1, min(10, max_hops))
    papers = nodes.filter(F.col("label") == "Paper") if "label" in nodes.columns else nodes.limit(0)
    for pool in (papers, nodes):
        a, b = concept_nodes(pool, concept_a), concept_nodes(pool, concept_b)
        out = cut_lineage(_search(edges, a, b, max_hops, limit))
        if has_rows(out):
            break
    return out


def _search(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_hops: int, k: int) -> DataFrame:
    links = cut_lineage(
        edges.select(F.col("src").alias("x"), F.col("dst").alias("y"))
        .unionByName(edges.select(F.col("dst").alias("x"), F.col("src").alias("y")))
        .filter(F.col("x") != F.col("y")).distinct())
    goals = goals.select(F.col("id").alias("node")).distinct()
    seen = level = cut_lineage(starts.distinct().select(
        F.col("id").alias("node"), F.col("id").alias("source"), F.lit(0).alias("hops"), F.array("id").alias("path")))
    order = [F.asc("hops"), F.asc("source")]
    for hop in range(1, max_hops + 1):
        reached = (
            level.join(links, F.col("node") == F.col("x"))
            .select(F.col("y").alias("node"), "source", F.lit(hop).alias("hops"),
                    F.concat("path", F.array("y")).alias("path"))
            .groupBy("node", "source", "hops").agg(F.min("path").alias("path"))
            .join(seen.select("node", "source"), ["node", "source"], "left_anti")
        )
        # The start itself takes one of the places, hence one more than asked.
        seen = cut_lineage(top_per(seen.unionByName(reached.select(*seen.columns)), "node", order, k + 1))
        level = seen.filter(F.col("hops") == hop)
        done = seen.join(goals, "node", "left_semi").filter(F.col("node") != F.col("source"))
        if has_rows(done, k) or not has_rows(level):
            break
    return cap(done.select(F.col("source"), F.col("node").alias("target"), "hops", "path"),
               [F.asc("hops"), F.asc("source"), F.asc("target")], k)


def neighborhood(paper_id, conns, papers, hops=2):
    """(nodes, links) within ``hops`` of a paper; the centre is drawn larger."""
    ends = half_edges(conns.filter(F.col("connection_type") != "replicates"))
    near = papers.sparkSession.createDataFrame([(paper_id,)], "me long" if isinstance(paper_id, int) else "me string")
    ids = None
    for _ in range(hops):
        step = ends.join(near, "me", "left_semi").select("connection_id").distinct()
        ids = step
        near = ends.join(ids, "connection_id", "left_semi").select("me").distinct()
    links = conns.join(ids, "connection_id", "left_semi")
    nodes = papers.join(near.withColumnRenamed("me", "paper_id"), "paper_id", "left_semi").select(
        "paper_id", "title", "journal", "source",
        F.when(F.col("paper_id") == paper_id, 15).otherwise(5).alias("val"))
    return nodes, links


def graph_overview(conns, papers, limit=200):
    """(most connected papers, the best links among them)."""
    live = conns.filter(F.col("connection_type") != "replicates")
    top = cap(degree(live).join(papers.select("paper_id", "title", "journal", "source"), "paper_id"),
              [F.desc("connection_count"), F.asc("paper_id")], limit)
    nodes = top.select("paper_id", F.substring("title", 1, 60).alias("label"), "journal", "source",
                       F.least("connection_count", F.lit(20)).alias("val"))
    return nodes, induced_links(nodes, conns)


def cluster(conns, papers, discipline, limit=100):
    """(papers of a source or journal, their links)."""
    some = papers.filter((F.col("source") == discipline) | contains_ci(F.col("journal"), discipline))
    counted = some.join(degree(conns), "paper_id", "left").withColumn(
        "connection_count", F.coalesce("connection_count", F.lit(0)))
    top = cap(counted, [F.desc("connection_count"), F.asc("paper_id")], limit)
    nodes = top.select("paper_id", "title", "journal", "source",
                       F.least(F.greatest("connection_count", F.lit(1)), F.lit(20)).alias("val"))
    return nodes, induced_links(nodes, conns, None)


def ego(paper_id, conns, k=15) -> DataFrame:
    """The neighbours on a paper's first ``k`` connections, each once, by its surest link."""
    mine = half_edges(conns.filter((F.col("paper_a_id") == paper_id) | (F.col("paper_b_id") == paper_id)))
    first = cap(mine.filter(F.col("me") == paper_id), [F.desc("confidence"), F.asc("connection_id")], k)
    return latest_per(first, "other", [F.desc("confidence"), F.asc("connection_id")])
