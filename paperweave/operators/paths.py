"""Walks through edge tables: distances, paths, lineages. Frontiers are joined level by level and cut from their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, distinct."""
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def distances(edges: DataFrame, sources: DataFrame, most: int = 15) -> DataFrame:
    """(node, hops) of all nodes within ``most`` hops of a source (node) along edges (a, b), which are written once for all levels."""
    edges = cut(edges.select("a", "b"))
    return _levels(edges, sources, most)


def _levels(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    seen = cut(sources.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for hop in range(1, most + 1):
        step = edges.join(frontier, F.col("a") == F.col("node")).select(F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if not frontier.head(1):
            break
        seen = seen.unionByName(frontier)  # each level is written once
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 15) -> DataFrame:
    """(step, node) of one shortest path; of equally short ones that with the smallest nodes, seen from the target. No path, no rows."""
    spark = edges.sparkSession
    edges = cut(edges.select("a", "b"))
    found = _levels(edges, spark.createDataFrame([(source,)], "node string"), most)
    last = found.where(F.col("node") == target).head()
    if last is None:
        return spark.createDataFrame([], "step int, node string")
    path = [(last.hops, target)]
    while path[-1][0]:
        hop, node = path[-1]
        before = found.where(F.col("hops") == hop - 1).join(edges.where(F.col("b") == node), F.col("a") == F.col("node"), "left_semi")
        path.append((hop - 1, before.agg(F.min("node")).first()[0]))
    return spark.createDataFrame(path, "step int, node string")


def hops_of(path: DataFrame) -> DataFrame:
    """(step, a, b) of consecutive nodes of a path (step, node). A path is short."""
    after = F.lead("node").over(Window.orderBy("step"))
    return path.select("step", F.col("node").alias("a"), after.alias("b")).where("b IS NOT NULL")


def hop_edges(path: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (src, dst, type, strength), in either direction, that join consecutive nodes of a path."""
    h = hops_of(path)
    ways = h.select("step", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(h.select("step", F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    return edges.join(ways, ["src", "dst"]).select("step", "src", "dst", "type", "strength")


def alternative_paths(edges: DataFrame, source: str, target: str, most_hops: int = 5, n: int = 5) -> DataFrame:
    """(path, step, node) of the first n paths by length and nodes; a path may revisit nodes but no edge. Edges (a, b) are undirected.

    Only nodes near enough to the target to reach it in the hops that remain are entered.
    """
    spark = edges.sparkSession
    both = undirected(edges)
    left = distances(both, spark.createDataFrame([(target,)], "node string"), most_hops).select(F.col("node").alias("b"), F.col("hops").alias("left"))
    near = both.join(left, "b")
    walk = spark.createDataFrame([(source, [source], [])], "node string, path array<string>, used array<string>")
    done = None
    for hop in range(1, most_hops + 1):
        edge = F.concat_ws("\t", F.least("a", "b"), F.greatest("a", "b"))
        step = walk.join(near.where(F.col("left") <= most_hops - hop), F.col("node") == F.col("a")).withColumn("e", edge)
        step = step.where(~F.array_contains("used", F.col("e")))
        walk = cut(step.select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"), F.concat("used", F.array("e")).alias("used")))
        hit = walk.where(F.col("node") == target).select("path")
        done = hit if done is None else done.unionByName(hit)
        if done.limit(n).count() == n:  # longer paths come later
            break
    order = [F.size("path"), F.array_join("path", "\t")]
    first = done.orderBy(*order).limit(n).withColumn("number", F.row_number().over(Window.orderBy(*order)))
    return first.select(F.col("number").alias("path_no"), F.posexplode("path").alias("step", "node"))


def adjacent(parents: DataFrame) -> DataFrame:
    """(node, via): every node with each node one hop away, up or down."""
    e = parents.select("child", "parent")
    return e.toDF("node", "via").unionByName(e.toDF("via", "node")).distinct()


#: Members of a class that are relatives in one row, and members that such a row pairs them with.
MEMBERS, NODES = 2048, 256
#: Tasks for each shuffle partition, over which these rows are dealt.
TASKS = 4


def two_hop_relatives(parents: DataFrame) -> DataFrame:
    """(node, relative) over exactly two different undirected edges of (child, parent): grandparents, grandchildren, siblings, co-parents.

    Nodes with the same neighbours have the same relatives but for themselves. Such a class is told by 128 bits of its neighbours' hashes;
    pairs are found between classes, each by its smallest node, and written out from rows of members that all tasks share evenly, so no
    pair is shuffled or compared.
    """
    every = cut(parents.select("child", "parent").distinct())
    e = every.dropna()
    steps = adjacent(e)
    mark = lambda seed: F.sum(F.xxhash64("via", F.lit(seed)).cast("decimal(20,0)"))
    classes = cut(steps.groupBy("node").agg(mark(1).alias("_1"), mark(2).alias("_2"), F.count(F.lit(1)).alias("_3")))
    firsts = classes.groupBy("_1", "_2", "_3").agg(F.min("node").alias("class"))
    members = cut(classes.join(firsts, ["_1", "_2", "_3"]).select("node", "class"))
    ways = cut(steps.join(members.where("node = class").select("node"), "node", "left_semi"))
    linked = ways.join(ways.select(F.col("node").alias("relative"), "via"), "via").select("node", "relative").distinct()
    # members of a class in rows of some thousand at most; a row of pairs holds some of a class's members and one such row of the other's
    packs = members.withColumn("_c", F.pmod(F.xxhash64("node"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("class")) / MEMBERS)))
    packs = cut(packs.groupBy("class", "_c").agg(F.collect_list("node").alias("_all")).select("class", "_all"))
    slices = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_all") / NODES).cast("int") - 1), lambda i: F.slice("_all", i * NODES + 1, NODES))
    left = linked.withColumnRenamed("node", "class").join(packs.select("class", F.explode(slices).alias("_nodes")), "class").select("relative", "_nodes")
    met = left.join(packs.withColumnRenamed("class", "relative"), "relative").select("_nodes", "_all")
    # rows stand for up to half a million pairs each, so they are dealt evenly whatever their bytes
    spark = parents.sparkSession
    met = met.repartition(TASKS * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    pairs = met.select(F.explode("_nodes").alias("node"), "_all").select("node", F.explode("_all").alias("relative")).where("node <> relative")
    # back to the node itself only where two edges join the same nodes, one each way
    both = e.where("child <> parent")
    again = both.join(both.select(F.col("parent").alias("child"), F.col("child").alias("parent")), ["child", "parent"], "left_semi")
    out = pairs.unionByName(again.select(F.col("child").alias("node"), F.col("child").alias("relative")).distinct())
    # edges with an end missing lead nowhere from there, and to a node that is none
    if not every.where("child IS NULL OR parent IS NULL").head(1):
        return out
    turn = lambda f: f.select(F.col("child").alias("x"), F.col("parent").alias("y"), "child", "parent").unionAll(f.select(F.col("parent").alias("x"), F.col("child").alias("y"), "child", "parent"))
    ends, open_ends = turn(every), turn(every.where("child IS NULL OR parent IS NULL"))
    apart = (F.col("o.y") == F.col("t.x")) & ~((F.col("o.child") == F.col("t.child")) & (F.col("o.parent") == F.col("t.parent")))
    found = [a.alias("o").join(b.alias("t"), apart).select(F.col("o.x").alias("node"), F.col("t.y").alias("relative")) for a, b in ((open_ends, ends), (ends, open_ends))]
    lost = found[0].unionByName(found[1]).where("node IS NULL OR relative IS NULL").distinct()
    return out.unionByName(lost)


def lineages(parents: DataFrame, most: int = 50) -> DataFrame:
    """(node, line, step, ancestor): a line per direct parent, from there always on to the smallest parent, up to a root.

    A line that returns to a node it has been at ends there.
    """
    first = parents.groupBy(F.col("child").alias("at")).agg(F.min("parent").alias("next"))
    level = cut(parents.distinct().select(F.col("child").alias("node"), F.col("parent").alias("line"), F.lit(1).alias("step"), F.col("parent").alias("ancestor"), F.array("child", "parent").alias("path")))
    out = level.drop("path")
    for step in range(2, most + 1):
        level = level.join(first, F.col("ancestor") == F.col("at")).where(~F.array_contains("path", F.col("next")))
        level = cut(level.select("node", "line", F.lit(step).alias("step"), F.col("next").alias("ancestor"), F.concat("path", F.array("next")).alias("path")))
        if not level.head(1):
            return out
        out = out.unionByName(level.drop("path"))
    return out


def ranked_lineages(taxa: DataFrame, ranks: DataFrame) -> DataFrame:
    """Lineages of taxa (child, parent, tax_id) with the rank of each ancestor, from ranks (node, rank); entries without a taxon are dropped."""
    lines = lineages(taxa.where("tax_id IS NOT NULL").select("child", "parent"))
    return lines.join(ranks.select(F.col("node").alias("ancestor"), "rank"), "ancestor", "left").select("node", "line", "step", "ancestor", "rank")


def descents(parents: DataFrame, most: int = 50) -> DataFrame:
    """The same downwards: a line per direct child, from there always on to the smallest child."""
    return lineages(parents.select(F.col("parent").alias("child"), F.col("child").alias("parent")), most)
