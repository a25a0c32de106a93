"""Greedy clusterings and group merges, settled in parallel rounds that equal the sequential pass.

A sequential pass decides one seed after the other.  A seed whose decision no earlier, open
seed can touch may be decided at once; each round decides all of these, so the number of rounds
follows the longest chain of seeds that depend on each other, not their number.  Rounds
are written to the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import graph, similarity
from palimpsest.sources.shared import written

MOST_ROUNDS = 500
PER_CLUSTER = 5
MOST_SOURCES = 50


def concept_clusters(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, id): disjoint clusters of concepts, seeds by falling degree (ties: id), each with all open concepts within two steps.

    ``nodes``: id, type, stale; ``edges``: src, dst, stale.  A step may pass nodes of other kinds and stale
    concepts, but no concept that an earlier cluster took.  Clusters of one concept are left out; ``most``
    keeps the first clusters by their seeds.

    A concept can only be touched by seeds within four steps, so one that comes first among the
    open concepts there is decided, with all like it, in the same round.
    """
    live = edges.where("NOT coalesce(stale, false)").select("src", "dst")
    links = written(graph.both_ways(live).distinct(), "links")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    concepts = nodes.where("type = 'concept' AND NOT coalesce(stale, false)").select("id").distinct()
    places = written(concepts.join(degree, "id").select("id", F.struct((-F.col("degree")).alias("d"), F.col("id").alias("id")).alias("place")), "concepts")
    links = links.where("src <> dst")
    done, open_ = [], places
    for _ in range(MOST_ROUNDS):
        if open_.isEmpty():
            break
        best = open_.select(F.col("id").alias("node"), "place")
        for _ in range(4):
            near = links.join(best, links["src"] == best["node"]).select(F.col("dst").alias("node"), "place")
            best = best.unionByName(near).groupBy("node").agg(F.min("place").alias("place"))
        best = written(best, "first-within-four")
        seeds = best.join(open_.select("id"), F.col("node") == F.col("id"), "left_semi").where("node = place.id").select("node", F.col("node").alias("seed"))
        reach = seeds
        for _ in range(2):
            reach = reach.unionByName(links.join(reach, links["src"] == reach["node"]).select(F.col("dst").alias("node"), "seed")).distinct()
        taken = written(open_.join(reach, F.col("id") == F.col("node")).select("seed", "id"), "taken")
        done.append(taken)
        gone = taken.select("id")
        open_ = written(open_.join(gone, "id", "left_anti"), "open")
        links = written(links.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"), "links")
    else:
        raise RuntimeError("clusters did not settle")
    if not done:
        return places.select(F.col("id").alias("seed"), "id")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    several = found.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").join(places.select(F.col("id").alias("seed"), "place"), "seed")
    if most is not None:
        several = several.orderBy("place").limit(most)
    return found.join(several.select("seed"), "seed", "left_semi")


def leaders(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, leader) by a pass over nodes (id) in order: a node that no leader holds yet leads, and holds its open neighbours (a, b).

    Leaders are the first maximal independent set in the order of ids.
    """
    links = written(pairs.select(F.greatest("a", "b").alias("late"), F.least("a", "b").alias("early")).where("late <> early").distinct(), "links")
    open_ = written(nodes.select("id").distinct(), "open")
    done = None
    left = links
    for _ in range(MOST_ROUNDS):
        if open_.isEmpty():
            break
        lead = open_.join(left.select(F.col("late").alias("id")).distinct(), "id", "left_anti")
        lead = written(lead, "leaders")
        held = left.join(lead.select(F.col("id").alias("early")), "early", "left_semi").select(F.col("late").alias("id")).distinct()
        done = lead if done is None else done.unionByName(lead)
        out = written(lead.unionByName(held), "decided")
        open_ = written(open_.join(out, "id", "left_anti"), "open")
        left = written(left.join(out.toDF("late"), "late", "left_anti").join(out.toDF("early"), "early", "left_anti"), "links")
    else:
        raise RuntimeError("leaders did not settle")
    if done is None:
        return nodes.select("id", F.col("id").alias("leader"))
    done = written(done, "all-leaders")
    # a follower belongs to the first leader next to it, which comes before it
    follows = links.join(done.toDF("early"), "early").join(done.toDF("late"), "late", "left_anti").groupBy(F.col("late").alias("id")).agg(F.min("early").alias("leader"))
    return done.select("id", F.col("id").alias("leader")).unionByName(follows)


def term_clusters(facts: DataFrame, lessons: DataFrame, most: int | None = None, above: float = 0.3, longer_than: int = 3) -> DataFrame:
    """(leader, term): clusters of terms that occur in the same rows, by a pass over terms in the order of their first appearance.

    Terms are the words of ``facts`` (id, fact) and the tags of ``lessons`` (id, tags), lower-cased, that two rows at least hold.  A
    term that no cluster holds yet leads one and takes the open terms whose rows overlap with its own by
    more than ``above``.  Facts come before lessons, each by id.  Clusters of one term are left out; ``most`` keeps the first.
    """
    words = F.filter(F.split(F.lower(F.coalesce("fact", F.lit(""))), r"\s+"), lambda t: F.char_length(t) > longer_than)
    a = facts.select(F.struct(F.lit(0).alias("kind"), F.col("id").cast("string").alias("id")).alias("row"), F.posexplode(words).alias("pos", "term"))
    b = lessons.select(F.struct(F.lit(1).alias("kind"), F.col("id").cast("string").alias("id")).alias("row"), F.posexplode(F.transform("tags", F.lower)).alias("pos", "term"))
    each = a.unionByName(b)
    terms = each.groupBy("term").agg(F.min(F.struct("row", "pos")).alias("first"), F.collect_set(F.col("row.id")).alias("rows")).where(F.size("rows") >= 2)
    terms = written(terms.withColumn("id", F.struct("first", "term")), "terms")
    pairs = similarity.shared_counts(terms, above, "id", "rows").where(F.col("shared") > above * F.col("total"))
    found = leaders(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), terms)
    several = found.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    if most is not None:
        several = several.orderBy("leader").limit(most)
    return found.join(several.select("leader"), "leader", "left_semi").select(F.col("leader.term").alias("leader"), F.col("id.term").alias("term"))


def threads(messages: DataFrame, key: str = "id", parent: str = "reply_to", thread: str = "thread_id") -> DataFrame:
    """(key, thread_id): a message's own thread, else that of the message that it answers, else that message's id, whatever the depth.

    Pointers to parents double every round, so rounds grow with the logarithm of the depth.  A message
    that answers nothing that exists, and has no thread, has none.  Messages that answer each other in a circle, or one of
    a circle, have the smallest id of the circle.
    """
    rows = messages.select(F.col(key).alias("id"), F.col(parent).alias("parent"), F.col(thread).alias("own"))
    there = rows.select(F.col("id").alias("_p"))
    rows = rows.join(there, F.col("parent") == F.col("_p"), "left").select("id", F.when(F.col("own").isNull(), F.col("_p")).alias("parent"), "own")
    rows = written(rows, "messages")
    ends = rows.where("parent IS NULL").select("id", F.coalesce("own", "id").alias("thread"))
    walking = written(rows.where("parent IS NOT NULL").select("id", F.col("parent").alias("at"), F.col("id").alias("least")), "walking")
    known, found, steps, n = ends, [], 1, walking.count()
    while not walking.isEmpty():
        arrived = written(walking.join(known.select(F.col("id").alias("at"), "thread"), "at").select("id", "thread"), "arrived")
        found.append(arrived)
        known = known.unionByName(arrived)
        walking = walking.join(arrived, "id", "left_anti")
        if steps > 4 * n:  # what still walks is in a circle or leads into one, and has gone round it
            circle = walking.select(F.col("id").alias("at"), F.col("least").alias("thread"))
            found.append(written(walking.join(circle, "at").select("id", "thread"), "arrived"))
            break
        ahead = walking.select(F.col("id").alias("_i"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        met = walking.join(ahead, F.col("at") == F.col("_i"), "left")
        walking = written(met.select("id", F.coalesce("_at", "at").alias("at"), F.least("least", "_least").alias("least")), "walking")
        steps *= 2
    own = rows.where("parent IS NULL").select("id", F.col("own").alias("thread"))
    for part in found:
        own = own.unionByName(part)
    return own.select(F.col("id").alias(key), F.col("thread").alias(thread))


# ---------------------------------------------------------------- insights


def cluster_key(project: str, concepts: str):
    return F.concat_ws("|", F.coalesce(project, F.lit("")), F.array_join(F.array_sort(F.transform(concepts, F.lower)), ","))


def collapse_insights(insights: DataFrame, keep: int = PER_CLUSTER, most_sources: int = MOST_SOURCES) -> tuple[DataFrame, DataFrame]:
    """The insights left when each cluster keeps its ``keep`` strongest, and (id, merged_into) of the others.

    ``insights``: id, project, concepts, content, confidence, reinforcements, created_at, last_reinforced_at,
    source_memory_ids, source_lesson_ids, deleted.  Strongest: most reinforcements, then confidence, then last use, then id.  Another goes to the
    survivor most like it by words (ties: the stronger), which gets the sum of reinforcements, the highest confidence, the latest
    reinforcement, all lessons, and the last ``most_sources`` distinct memories in the order of merging.  Deleted insights stay as they are.
    """
    live = insights.where("NOT coalesce(deleted, false)").withColumn("_key", cluster_key("project", "concepts"))
    used = F.coalesce("last_reinforced_at", "created_at")
    order = Window.partitionBy("_key").orderBy(F.desc("reinforcements"), F.desc("confidence"), used.desc(), "id")
    ranked = written(live.withColumn("_r", F.row_number().over(order)), "ranked-insights")
    said = F.lower(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+$", ""))
    words = text.word_set(F.col("content"))
    stay = ranked.where(F.col("_r") <= keep).select("_key", F.col("id").alias("into"), F.col("_r").alias("_s"), words.alias("_w"), said.alias("_t"))
    go = ranked.where(F.col("_r") > keep).select("_key", "id", "_r", words.alias("_words"), said.alias("_text"))
    pairs = go.join(stay, "_key").withColumn("_like", text.jaccard(F.col("_words"), F.col("_w"), F.col("_text"), F.col("_t")))
    best = pairs.groupBy("id", "_r").agg(F.max_by("into", F.struct("_like", -F.col("_s"))).alias("merged_into"))
    merged = written(best, "merged-insights")
    # everything that meets in a survivor, itself first, the others in their order
    parts = ranked.where(F.col("_r") <= keep).select(F.col("id").alias("into"), "id", F.lit(0).alias("_turn"))
    parts = parts.unionByName(merged.select(F.col("merged_into").alias("into"), "id", F.col("_r").alias("_turn")))
    all_of = parts.join(ranked.select("id", "reinforcements", "confidence", "last_reinforced_at", "source_memory_ids", "source_lesson_ids"), "id")
    sums = all_of.groupBy("into").agg(F.sum("reinforcements").alias("reinforcements"), F.max("confidence").alias("confidence"), F.max("last_reinforced_at").alias("last_reinforced_at"),
                                      F.max("_turn").alias("_n"))
    memories = all_of.select("into", "_turn", F.posexplode("source_memory_ids").alias("_pos", "_m")).groupBy("into", "_m").agg(F.max(F.struct("_turn", "_pos")).alias("_at"))
    late = memories.withColumn("_r", F.row_number().over(Window.partitionBy("into").orderBy(F.desc("_at")))).where(F.col("_r") <= most_sources)
    late = late.groupBy("into").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda x: x["_m"]).alias("source_memory_ids"))
    lessons = all_of.select("into", "_turn", F.posexplode("source_lesson_ids").alias("_pos", "_l")).groupBy("into", "_l").agg(F.min(F.struct("_turn", "_pos")).alias("_at"))
    lessons = lessons.groupBy("into").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_l"))), lambda x: x["_l"]).alias("source_lesson_ids"))
    fresh = sums.where("_n > 0").join(late, "into", "left").join(lessons, "into", "left")
    new = {c: F.struct(*[F.col(f"fresh.{n}") for n in ("reinforcements", "confidence", "last_reinforced_at", "source_memory_ids", "source_lesson_ids")]) for c in ("_v",)}
    joined = insights.join(merged.select("id"), "id", "left_anti").alias("rows").join(fresh.alias("fresh"), F.col("rows.id") == F.col("fresh.into"), "left").select("rows.*", F.col("fresh.into").alias("_into"), new["_v"].alias("_v"))
    names = ("reinforcements", "confidence", "last_reinforced_at", "source_memory_ids", "source_lesson_ids")
    kinds = dict(insights.dtypes)
    swapped = joined.withColumns({c: F.when(F.col("_into").isNotNull(), F.coalesce(F.col(f"_v.{c}"), F.col(c))).otherwise(F.col(c)).cast(kinds[c]) for c in names})
    return swapped.select(*insights.columns), merged.select("id", "merged_into")


def remap(rows: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """``rows`` whose references to merged ids point to the survivors."""
    to = merged.select(F.col("id").alias("_old"), F.col("merged_into").alias("_new"))
    out = rows.join(to, F.col(column) == F.col("_old"), "left")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
