"""Graph operators over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage, release

#: A walk's rounds are put together into one table after so many.
MERGE_EVERY = 16


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    component is the smallest node reachable. Alternates large-star and small-star
    steps; every step is a grouped minimum and a join, so no neighbour list is ever
    held in one task. Null ends and self-loops are ignored.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = cut_lineage(e)
    signature = None
    while True:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == signature:
            break
        signature = (row["n"], row["h"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, old = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()), e
        release(old)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 30, cut_every: int = 6) -> DataFrame:
    """(node, rank) after a fixed number of rounds; the weight of nodes without targets is lost and ranks are scaled once at the end.

    edges (src, dst) may repeat; a null dst marks a node without targets. A round is one join and one grouped
    sum: every node takes part in the sum with a share of its own, so no second join brings back nodes without links.
    """
    e = edges.where("src is not null").distinct()
    # one row a link, and one without a target for each node, which keeps the node and its base
    ends = e.where("dst is not null")
    out = ends.groupBy("src").agg(F.count("*").alias("out"))
    nodes = e.select(F.col("src").alias("node")).unionByName(ends.select(F.col("dst").alias("node"))).distinct()
    stay = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("long").alias("out"))
    links = cut_lineage(ends.join(out, "src").select("src", "dst", "out").unionByName(stay).repartition("src"))
    n = links.where("out is null").count()
    ranks, held = links.where("out is null").select(F.col("src").alias("node"), F.lit(1.0 / max(n, 1)).alias("rank")), None
    base = (1.0 - damping) / max(n, 1)
    share = F.when(F.col("out").isNotNull(), F.lit(damping) * F.col("rank") / F.col("out")).otherwise(F.lit(base))
    for i in range(rounds):
        ranks = links.join(ranks, links.src == ranks.node).groupBy(F.col("dst").alias("node")).agg(F.sum(share).alias("rank"))
        if i % cut_every == cut_every - 1:
            ranks = cut_lineage(ranks)
            release(held)
            held = ranks
    total = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select("node", (F.col("rank") / F.lit(total or 1.0)).alias("rank"))


def symbol_edges(modules: DataFrame, exports: DataFrame, bases: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges for ranking symbols: module to export, child to base, module to relatively imported name; known names only, no self-loops.

    Inputs: exports (module, name), bases (name, base), imports (module, name), symbols (name). Every symbol is a node.
    """
    known = symbols.select(F.col("name").alias("dst")).distinct()
    mod = F.concat(F.lit("__mod__"), F.col("module"))
    e = exports.select(mod.alias("src"), F.col("name").alias("dst")).unionByName(bases.select(F.col("name").alias("src"), F.col("base").alias("dst"))).unionByName(imports.select(mod.alias("src"), F.col("name").alias("dst")))
    e = e.join(known, "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()
    return e.unionByName(known.select(F.col("dst").alias("src"), F.lit(None).cast("string").alias("dst")))


def stars(score: Column, symbols: Column) -> Column:
    """1 to 5 from a module's best rank and its number of symbols; no symbols: 1."""
    c = score * 100 + symbols * 0.5
    return F.when(symbols == 0, 1).when(c > 5, 5).when(c > 3, 4).when(c > 1.5, 3).when(c > 0.5, 2).otherwise(1)


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth): nodes reached from each start by at most `most` steps, with the fewest steps; starts have depth 0."""
    e = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    frontier, depth = cut_lineage(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()), 0
    rounds = [frontier]  # what each round found; put together from time to time
    while most is None or depth < most:
        depth += 1
        seen = reduce(DataFrame.unionByName, rounds)
        new = frontier.join(e, frontier.node == e.src).select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        frontier = cut_lineage(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        if len(rounds) == MERGE_EVERY:
            seen = cut_lineage(seen)
            release(*rounds[:-1])
            rounds = [seen]
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)


def trace(edges: DataFrame, start: str, most: int = 5) -> DataFrame:
    """(node, depth, chain): a breadth-first walk that keeps the first path to each node, by order of names at equal depth."""
    e = cut_lineage(edges.select("src", "dst").distinct())
    seen = cut_lineage(e.sparkSession.createDataFrame([(start, 0, [start])], "node string, depth int, chain array<string>"))
    frontier = seen
    for depth in range(1, most + 1):
        step = frontier.join(e, frontier.node == e.src).select(F.col("dst").alias("node"), F.concat("chain", F.array("dst")).alias("chain"))
        first = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("chain").alias("chain"))
        frontier = cut_lineage(first.select("node", F.lit(depth).alias("depth"), "chain"))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components with more than one node; component is the smallest node.

    Forward-backward colouring: nodes without an incoming or outgoing edge go first; the smallest label is spread
    forward until nothing changes, and what reaches its label's node backwards within one label is a component.
    """
    e = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    found = None
    while not e.isEmpty():
        while True:  # trim
            size = e.count()
            e, old = cut_lineage(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")), e
            release(old)
            if e.count() == size:
                break
        if e.isEmpty():
            break
        colour = held = cut_lineage(e.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            got = colour.join(e, colour.node == e.src).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("got"))
            new = cut_lineage(colour.join(got, "node", "left").select("node", F.least("colour", F.coalesce("got", "colour")).alias("colour"), (F.col("got") < F.col("colour")).alias("moved")))
            done = new.where("moved").isEmpty()
            release(held)
            colour, held = new.select("node", "colour"), new
            if done:
                break
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd"))
        inside = cut_lineage(e.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        own = cut_lineage(colour.where("node = colour").select("node", "colour"))
        frontier, before = own, None
        while True:  # backwards within a colour
            back = frontier.toDF("dst", "colour").join(inside, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = cut_lineage(back.join(own, ["node", "colour"], "left_anti"))
            if frontier.isEmpty():
                break
            own, old = cut_lineage(own.unionByName(frontier)), own
            release(old, before)
            before = frontier
        found = own if found is None else found.unionByName(own)
        rest = own.select("node")
        e, old = cut_lineage(e.join(rest.select(F.col("node").alias("src")), "src", "left_anti").join(rest.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")), e
        release(old, inside, held)
    if found is None:
        return e.select(F.col("src").alias("node"), F.col("src").alias("component"))
    big = found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(big, "colour").select("node", F.col("colour").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components, and nodes with an edge to themselves."""
    own = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    s = strong_components(edges)
    return s.unionByName(own.join(s, "node", "left_anti"))


def new_cycles(edges: DataFrame, adds: DataFrame, removes: DataFrame) -> DataFrame:
    """(members): node sets of components that exist after the edits and did not before."""
    after = edges.select("src", "dst").distinct().join(removes, ["src", "dst"], "left_anti").unionByName(adds.select("src", "dst")).distinct()
    sets = lambda s: s.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members")).select("members")
    return sets(cycles(after)).join(sets(cycles(edges)), "members", "left_anti")


def shared_helpers(edges: DataFrame, moved: DataFrame, remaining: DataFrame) -> DataFrame:
    """Nodes reached from a moved node and from a remaining one, themselves neither."""
    near = lambda s: reach(edges, s).where("depth > 0").select("node").distinct()
    both = near(moved).join(near(remaining), "node", "left_semi")
    return both.join(moved.unionByName(remaining), "node", "left_anti")


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): dependencies (dst) on lower levels than what needs them (src); nodes on or behind a cycle come last.

    Level by level: a node is placed once all its dependencies are; what is left when nothing more can be placed
    gets one level beyond.
    """
    e = cut_lineage(edges.select("src", "dst").where("src <> dst").distinct())
    left = cut_lineage(nodes.select("node").distinct())
    placed, level = None, 0
    while not left.isEmpty():
        ready = left.join(e.select(F.col("src").alias("node")), "node", "left_anti")
        ready = cut_lineage(ready)
        last = ready.isEmpty()
        ready = (left if last else ready).withColumn("level", F.lit(level))
        placed = ready if placed is None else placed.unionByName(ready)
        if last:
            break
        next_left = cut_lineage(left.join(ready, "node", "left_anti"))
        next_e = cut_lineage(e.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti"))
        release(left, e)
        left, e = next_left, next_e
        level += 1
    return placed if placed is not None else left.withColumn("level", F.lit(0))
