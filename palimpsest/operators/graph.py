"""Graph operators on edge tables (src, dst, weight): degrees, walks, bounded paths, extraction, provenance."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring
from palimpsest.operators import mining
from palimpsest.sources.shared import written


def both_ways(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.unionByName(edges.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns]))


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge (src, dst): the smallest node that it can reach.

    Each round, a node's neighbours all get its smallest one in its place, in both directions in turn, until
    every component is a star.  Rounds are written to the shared folder; the driver sees counts and checksums.
    """
    down = lambda e: e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()
    links, before = written(down(edges.select("src", "dst")), "edges"), None
    for _ in range(most_rounds):
        least = both_ways(links).groupBy("src").agg(F.min("dst").alias("dst")).select("src", F.least("src", "dst").alias("least"))
        wide = down(both_ways(links).join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")))
        least = wide.groupBy("src").agg(F.min("dst").alias("least"))
        close = wide.join(least, "src")
        links = written(down(close.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(least.withColumnRenamed("least", "dst"))), "edges")
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("src", "dst").cast("decimal(38, 0)")), F.sum(F.xxhash64("src", "dst").cast("decimal(38, 0)"))).first()
        if now == before:
            stars = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
        before = now
    raise RuntimeError("components did not settle")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def top_degree(edges: DataFrame, k: int = 500) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def bfs(edges: DataFrame, start: DataFrame, depth: int = 3, types: DataFrame | None = None, wanted: str | None = None) -> DataFrame:
    """(node, depth) of nodes within ``depth`` undirected steps of the start nodes; each round drops what is known.

    The frontier of a round is written, so the next one reads it instead of walking again.
    With ``types`` (node, type) only nodes of the wanted type are returned; the walk passes all.
    """
    steps = both_ways(edges.select("src", "dst")).distinct()
    frontier = written(start.select("node").distinct(), "frontier")
    rounds = [frontier.withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        reached = steps.join(frontier, steps["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        for known in rounds:
            reached = reached.join(known.select("node"), "node", "left_anti")
        frontier = written(reached, "frontier")
        rounds.append(frontier.withColumn("depth", F.lit(d)))
    found = reduce(DataFrame.unionByName, rounds)
    return found if wanted is None else found.join(types.where(F.col("type") == wanted).select("node"), "node", "left_semi")


def cheapest_paths(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(node, cost, hops) by cost 1 / weight within ``depth`` steps; see ``paths_from``."""
    found = paths_from(edges, start.select(F.lit(0).alias("start"), "node"), depth)
    return found.groupBy("node").agg(F.min(F.struct("cost", "hops")).alias("b")).select("node", "b.cost", "b.hops")


def paths_from(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, node, cost, hops, total): cheapest paths from each start (start, node), and the sum of the weights along them.

    Rounds of relaxation, each written; only nodes whose cheapest path so far is shorter than
    the bound go on.  Ties: fewer steps, then the larger sum.
    """
    steps = both_ways(edges.select("src", "dst", "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    steps = steps.select("src", "dst", "weight", scoring.edge_cost(F.col("weight")).alias("step"))
    best = written(starts.select("start", "node", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(0.0).alias("total")).distinct(), "paths")
    for _ in range(depth):
        onward = best.where(F.col("hops") < depth)
        reached = steps.join(onward, steps["src"] == onward["node"]).select(
            "start", F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"), (F.col("total") + F.col("weight")).alias("total"))
        low = best.unionByName(reached).groupBy("start", "node").agg(F.min(F.struct("cost", "hops", (-F.col("total")).alias("total"))).alias("b"))
        best = written(low.select("start", "node", "b.cost", "b.hops", (-F.col("b.total")).alias("total")), "paths")
    return best


def matching_nodes(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, node) whose name holds an entity (query_id, entity) or is held by one, in any case.

    Distinct names and entities, which are few beside the records, are cut into their substrings of
    the lengths that the other side has; only those lengths, a few numbers, go through the driver.
    """
    asked = entities.select("query_id", F.lower("entity").alias("entity")).where("entity <> ''").distinct()
    named = nodes.select("node", F.lower("name").alias("name")).where("name <> ''")
    names, words = named.select("name").distinct(), asked.select("entity").distinct()

    def parts(column: str, lengths: DataFrame, length: str) -> DataFrame:
        """Substrings of a column with the lengths that occur on the other side."""
        have = sorted(r.k for r in lengths.select(F.char_length(length).alias("k")).distinct().collect())
        rows = names if column == "name" else words
        spots = rows.select(column, F.explode(F.array(*map(F.lit, have or [1]))).alias("k")).where(F.char_length(column) >= F.col("k"))
        return spots.select(column, F.explode(F.transform(F.sequence(F.lit(1), F.char_length(column) - F.col("k") + 1), lambda i: F.substring(F.col(column), i, F.col("k")))).alias("part")).distinct()

    holds = parts("name", words, "entity").join(words, F.col("part") == F.col("entity")).select("name", "entity")
    held = parts("entity", names, "name").join(names, F.col("part") == F.col("name")).select("name", "entity")
    pairs = holds.unionByName(held).distinct()
    return asked.join(pairs, "entity").join(named, "name").select("query_id", "node").distinct()


def search_entities(nodes: DataFrame, edges: DataFrame, entities: DataFrame, sources: DataFrame, depth: int = 2, k: int = 20) -> DataFrame:
    """(query_id, id, score): records behind the nodes that a query's entities name and those within reach of them.

    A record scores by the mean weight of the path to its node over the nodes on it, a record of a
    start node 1.  Of several start nodes the smallest that reaches a record decides, and for it
    paths, cheapest first, before its own records.  ``nodes``: node, name; ``sources``: node, id.
    """
    begun = matching_nodes(nodes, entities)
    paths = paths_from(edges, begun.select(F.col("node").alias("start"), "node").distinct(), depth)
    rows = begun.withColumnRenamed("node", "start").join(paths, "start").join(sources.select("node", "id").distinct(), "node")
    score = F.when(F.col("hops") == 0, 1.0).otherwise(F.col("total") / F.col("hops") / (F.col("hops") + 1))
    first = rows.groupBy("query_id", "id").agg(F.min_by(score, F.struct("start", F.col("hops") == 0, "cost", "node")).alias("score"))
    return limited(first, k)


def expand_hits(edges: DataFrame, hits: DataFrame, sources: DataFrame, depth: int = 1, k: int = 5) -> DataFrame:
    """(query_id, id, score): other records within reach of the nodes behind a query's first hits (query_id, id).

    A record scores half over two more than the steps to its node; of several start nodes the
    smallest that reaches it decides.
    """
    begun = hits.select("query_id", "id").join(sources, "id").select("query_id", F.col("node").alias("start")).distinct()
    paths = paths_from(edges, begun.select("start", F.col("start").alias("node")).distinct(), depth).where("hops > 0")
    rows = begun.join(paths, "start").join(sources.select("node", "id").distinct(), "node").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = rows.groupBy("query_id", "id").agg(F.min_by(0.5 / (F.col("hops") + 2), F.struct("start", "cost", "node")).alias("score"))
    return limited(first, k)


def limited(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("score", F.round("score", 9)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def related(links: DataFrame, starts: DataFrame, hops: int = 2, least: float = 0.0) -> DataFrame:
    """(start, id, hop, confidence) of the records within ``hops`` links (a, b, confidence) of each start (start).

    Confidence is the largest of the links to records found before, half where a link has none.
    """
    both = links.select("a", "b", "confidence").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    seen = written(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("hop"), F.lit(1.0).alias("confidence")).distinct(), "related")
    for hop in range(1, min(hops, 5) + 1):
        last = seen.where(F.col("hop") == hop - 1)
        reached = both.join(last, both["a"] == last["id"]).select("start", F.col("b").alias("id"), both["confidence"]).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        found = reached.groupBy("start", "id").agg(F.coalesce(F.max("confidence"), F.lit(0.5)).alias("confidence"))
        seen = written(seen.unionByName(found.select("start", "id", F.lit(hop).alias("hop"), "confidence")), "related")
    return seen.where((F.col("hop") > 0) & (F.col("confidence") >= least))


def merged_file_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one file become one, under the path below the longest root (root) that holds it; edges follow.

    ``nodes``: node, type, name, and created_at if known.  Of several nodes the one that has the path
    as its name stays, else the oldest, then the smallest; an edge whose ends fall together goes, equal ones merge with the
    largest weight.
    """
    clean = F.regexp_replace("name", r"^(\./)+", "")
    made = F.col("created_at") if "created_at" in nodes.columns else F.lit(None).cast("timestamp")
    files = nodes.where("type = 'file'").select("node", clean.alias("path"), "name", made.alias("_made"))
    heads = files.select("node", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split(F.col("path"), "/"), 1, n), "/"))).alias("head"))
    held = heads.join(roots.select(F.regexp_replace("root", "/+$", "").alias("head")).distinct(), "head").groupBy("node").agg(F.max_by("head", F.char_length("head")).alias("root"))
    named = files.join(held, "node", "left").withColumn("rel", F.when(F.col("root").isNull() | (F.col("root") == F.col("path")), F.col("path")).otherwise(F.substr("path", F.char_length("root") + 2)))
    first = F.struct((F.col("name") != F.col("rel")).alias("other"), F.col("_made").isNull().alias("unknown"), "_made", "node")
    into = named.join(named.groupBy("rel").agg(F.min_by("node", first).alias("into")), "rel").select("node", "into", "rel")
    kept = nodes.join(into, "node", "left").where("into IS NULL OR into = node").select("node", "type", F.coalesce("rel", "name").alias("name"))
    a, b = into.select(F.col("node").alias("src"), F.col("into").alias("_a")), into.select(F.col("node").alias("dst"), F.col("into").alias("_b"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_a", "src").alias("src"), F.coalesce("_b", "dst").alias("dst"), "type", "weight").where("src <> dst")
    return kept, merge_edges(moved)


def keyword_nodes(nodes: DataFrame, edges: DataFrame, keyword: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, name, properties: a map) with the keyword in their name or a property, and the edges at them."""
    word = F.lit(keyword.lower())
    held = F.contains(F.lower("name"), word) | F.coalesce(F.exists(F.map_values("properties"), lambda v: F.contains(F.lower(v), word)), F.lit(False))
    hits = nodes.where(held)
    ends = hits.select("node")
    return hits, edges.join(ends, F.col("src") == ends["node"], "left_semi").unionByName(edges.join(ends, F.col("dst") == ends["node"], "left_semi")).distinct()


def stale_by_source(rows: DataFrame, sources: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (node) with a flag on those that share a source (node, source) with the superseded record's sources (source)."""
    hit = sources.join(gone.select("source").distinct(), "source", "left_semi").select("node").distinct().withColumn("stale", F.lit(True))
    return rows.join(hit, "node", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


def heuristic_edges(rows: DataFrame, observation: str, concept: str, file: str, budget: int = 12, weight: float = 0.4) -> DataFrame:
    """(src, dst, n_observations, weight): concepts joined to the files of their observation, at most 12 edges each.

    Concepts and files are limited per observation before they are paired, so
    an observation of any size gives a bounded number of rows.
    """
    parts = mining.parts_of(rows.sparkSession, rows.count())

    def some(column: str) -> DataFrame:
        values = rows.select(F.col(observation).alias("o"), F.col(column).cast("string").alias("v")).where("v IS NOT NULL")
        return mining.first_distinct(values, "o", "v", budget, parts)

    pairs = some(concept).withColumnRenamed("v", "src").join(some(file).withColumnRenamed("v", "dst"), "o")
    pairs = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("o").orderBy("src", "dst"))).where(F.col("_r") <= budget)
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_observations")).withColumn("weight", F.lit(weight))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, type), with the largest weight and the number of merged rows."""
    return edges.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def orphans(nodes: DataFrame, sources: DataFrame, live: DataFrame) -> DataFrame:
    """Nodes (node) with sources (node, source), none of which is live (source)."""
    backed = sources.join(live.select("source").distinct(), "source", "left_semi").select("node").distinct()
    return nodes.select("node").distinct().join(sources.select("node").distinct(), "node", "left_semi").join(backed, "node", "left_anti")


def page_edges(edges: DataFrame, page: DataFrame) -> DataFrame:
    """Edges with both ends in a page of nodes."""
    nodes = page.select("node")
    return edges.join(nodes, edges["src"] == nodes["node"], "left_semi").join(nodes, F.col("dst") == nodes["node"], "left_semi")


def changes(edges: DataFrame, since, until, commit: str) -> DataFrame:
    """Edges committed between two times, ends included."""
    return edges.where((F.col(commit) >= since) & (F.col(commit) <= until))


def edge_stats(edges: DataFrame) -> DataFrame:
    """(type, n_edges, n_sources) of edges (type, src)."""
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_sources"))
