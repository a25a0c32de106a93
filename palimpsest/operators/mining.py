"""Counts, profiles, facets, threads and evaluation of result lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.sources.shared import written

PART = 500_000
SALTS = 16
WIDE = 500


def first_k(rows: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark limits rows per key before it shuffles."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def parts_of(spark: SparkSession, n: int) -> int:
    """Parts that grow in number, not in size, with n rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART))


def first_distinct(rows: DataFrame, key: str, value: str, k: int, parts: int) -> DataFrame:
    """The first k distinct values of each key, dealt by the key; a key with very many values is limited in ``SALTS`` places first."""
    dealt = rows.select(key, value).withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS))).repartition(parts, key, "_salt").distinct()
    few = first_k(dealt, [key, "_salt"], [value], k).drop("_salt")
    return first_k(few.repartition(parts, key), [key], [value], k)


def co_change_pairs(rows: DataFrame, session: str, file: str, per_session: int = 50, least: int = 3) -> DataFrame:
    """(file_a, file_b, n_sessions): files changed together in three sessions or more; a session counts its first 50 by name.

    Pairs hardly repeat within a task, so they are dealt before they are counted.
    """
    rows = rows.select(F.col(session).alias("s"), F.col(file).alias("f")).where("s IS NOT NULL AND f IS NOT NULL")
    files = written(first_distinct(rows, "s", "f", per_session, parts_of(rows.sparkSession, rows.count())), "session-files")
    often = files.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)  # what few sessions have is in no pair
    sets = files.join(often.select("f"), "f", "left_semi").groupBy("s").agg(F.sort_array(F.collect_list("f")).alias("fs"), F.count(F.lit(1)).alias("n"))
    sets = written(sets.select("fs", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n")), "session-sets")
    later = F.transform("fs", lambda f, i: F.struct(f.alias("a"), F.slice("fs", i + 2, F.size("fs")).alias("bs")))
    pairs = sets.select(F.explode(later).alias("p")).select(F.col("p.a").alias("file_a"), F.explode("p.bs").alias("file_b"))
    pairs = pairs.repartition(parts_of(rows.sparkSession, sets.agg(F.sum("n")).first()[0] or 0), "file_a", "file_b")
    return pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("n_sessions")).where(F.col("n_sessions") >= least)


def all_co_change_pairs(rows: DataFrame, session: str, file: str, least: int = 3) -> DataFrame:
    """(file_a, file_b, n_sessions): files changed together in so many sessions or more, of all files of all sessions.

    A session of more than ``WIDE`` files is wide; its pairs are made in cells of two blocks of files.  A file is left out of the
    pairs of its ``least - 1`` widest sessions: two files with so many sessions in common share another one (the prefix filter).
    Of the pairs found elsewhere, those sessions are counted afterwards, so a few wide sessions cost no pairs of their own.
    """
    rows = rows.select(F.col(session).alias("s"), F.col(file).alias("f")).where("s IS NOT NULL AND f IS NOT NULL")
    files = written(rows.repartition(parts_of(rows.sparkSession, rows.count()), "s", "f").distinct(), "session-files")
    often = files.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)  # what few sessions have is in no pair
    files = written(files.join(often.select("f"), "f", "left_semi"), "session-files")
    wide = written(files.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE), "wide-sessions")
    narrow = files.join(wide, "s", "left_anti").select("s", F.lit(0).alias("i"), F.lit(0).alias("j"), "f", F.lit(0).alias("block"))
    if any_wide := not wide.isEmpty():
        members = files.join(wide, "s")
        ranked = written(members.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), F.desc("s")))), "wide-files")
        left = ranked.where(F.col("r") >= least).select("s", "f")
        blocks = left.join(left.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("k")), "s").withColumn("block", F.pmod(F.xxhash64("f"), "k").cast("int"))
        cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("s", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "f", "block")
        narrow = narrow.unionByName(cells)
    sets = narrow.groupBy("s", "i", "j").agg(F.sort_array(F.collect_list(F.struct("f", "block"))).alias("fs"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sets = written(sets.select("i", "j", "fs", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n")), "session-sets")
    # in a cell of two blocks only files of different blocks meet
    after = lambda f, i: F.filter(F.slice("fs", i + 2, F.size("fs")), lambda g: (F.col("i") == F.col("j")) | (g["block"] != f["block"]))
    met = sets.select(F.explode(F.transform("fs", lambda f, i: F.struct(f["f"].alias("a"), F.transform(after(f, i), lambda g: g["f"]).alias("bs")))).alias("p"))
    pairs = met.select(F.col("p.a").alias("file_a"), F.explode("p.bs").alias("file_b"))
    pairs = pairs.repartition(parts_of(rows.sparkSession, sets.agg(F.sum("n")).first()[0] or 0), "file_a", "file_b")
    pairs = pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("n_sessions"))
    if not any_wide:
        return pairs.where(F.col("n_sessions") >= least)
    # the file whose left-out sessions reach further down has all that the two share of either's
    out = ranked.where(F.col("r") < least).groupBy("f").agg(F.min(F.struct("n", "s")).alias("down"), F.collect_list("s").alias("out"))
    of = lambda x: out.select(F.col("f").alias(f"file_{x}"), F.col("down").alias(f"down_{x}"), F.col("out").alias(f"out_{x}"))
    both = pairs.join(of("a"), "file_a", "left").join(of("b"), "file_b", "left")
    more = F.when(F.col("down_a") <= F.col("down_b"), F.struct(F.col("file_b").alias("f"), F.col("out_a").alias("out"))).when(F.col("down_b") < F.col("down_a"), F.struct(F.col("file_a").alias("f"), F.col("out_b").alias("out")))
    both = both.withColumn("more", more).where(F.col("n_sessions") + F.coalesce(F.size("more.out"), F.lit(0)) >= least)
    both = written(both.select("file_a", "file_b", "n_sessions", "more"), "pairs")
    asked = both.where("more IS NOT NULL").select("file_a", "file_b", F.col("more.f").alias("f"), F.explode("more.out").alias("s"))
    found = asked.join(ranked.select("s", "f"), ["s", "f"], "left_semi").select("file_a", "file_b", F.lit(1).cast("long").alias("n_sessions"))
    total = both.select("file_a", "file_b", "n_sessions").unionByName(found).groupBy("file_a", "file_b").agg(F.sum("n_sessions").alias("n_sessions"))
    return total.where(F.col("n_sessions") >= least)


def error_repeats(rows: DataFrame, title: str, session: str, least: int = 2) -> DataFrame:
    """Repeated titles, regardless of case, with their counts and numbers of sessions."""
    by_session = rows.groupBy(F.lower(title).alias("title"), F.col(session).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return by_session.groupBy("title").agg(F.sum("n").alias("n"), F.count("s").alias("n_sessions")).where(F.col("n") >= least)


def rules(pairs: DataFrame, errors: DataFrame, pair_least: int = 4, error_least: int = 3) -> DataFrame:
    """Frequent patterns as sentences."""
    a = pairs.where(F.col("n_sessions") >= pair_least).select(F.format_string("When %s changes, check %s (%d sessions)", F.col("file_a").cast("string"), F.col("file_b").cast("string"), "n_sessions").alias("rule"), F.col("n_sessions").alias("frequency"))
    b = errors.where(F.col("n") >= error_least).select(F.format_string("Recurring error: %s (%d times)", "title", "n").alias("rule"), F.col("n").alias("frequency"))
    return a.unionByName(b)


def top_values(rows: DataFrame, project: str, values: Column, k: int = 15) -> DataFrame:
    """The k most frequent elements of an array column for each project."""
    counts = rows.select(F.col(project).alias("project"), F.explode(values).alias("value")).groupBy("project", "value").agg(F.count(F.lit(1)).alias("n"))
    return first_k(counts, ["project"], [F.desc("n"), "value"], k)


def facet_rollup(facets: DataFrame) -> DataFrame:
    """Counts by dimension and value, by dimension, and in all (nulls stand for 'all')."""
    return facets.rollup("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_match(facets: DataFrame, wanted: list[tuple[str, str]], every: bool) -> DataFrame:
    """Targets with every (or any) wanted (dimension, value), and the number that matched."""
    hit = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value")) for d, v in wanted])
    found = facets.where(F.array_contains(hit, F.struct("dimension", "value"))).groupBy("target_id").agg(F.count_distinct("dimension", "value").alias("n_matched"))
    return found.where(F.col("n_matched") == len(set(wanted))) if every else found


def facet_values(facets: DataFrame) -> DataFrame:
    """The values of each dimension of a target, joined by commas."""
    return facets.groupBy("target_id", "dimension").agg(F.array_join(F.sort_array(F.collect_set("value")), ",").alias("vals"))


def concept_groups(rows: DataFrame, concept: str, importance: str, key: str, least_importance: float = 5, least: int = 3, k: int = 8) -> DataFrame:
    """(concept, key, importance, n): the k most important rows of concepts with three rows or more."""
    some = rows.where(F.col(importance) >= least_importance)
    sizes = some.groupBy(concept).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return first_k(some, [concept], [F.desc(importance), key], k).join(sizes, concept).select(concept, key, importance, "n")


def threads(messages: DataFrame, thread: str, at: str, sender: str) -> DataFrame:
    """Messages, last time and participants of each thread."""
    each = messages.groupBy(thread, sender).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    return each.groupBy(thread).agg(F.sum("n").alias("n_messages"), F.max("last").alias("last_at"), F.array_join(F.sort_array(F.collect_set(sender)), ",").alias("participants"))


def use_share(rows: DataFrame, source: str, used: Column) -> DataFrame:
    """Rows and used rows for each source and in all."""
    return rows.withColumn("_used", used.cast("long")).rollup(source).agg(F.count(F.lit(1)).alias("n_scored"), F.sum("_used").alias("n_used"))


def majority(rows: DataFrame, key: str, vote: str) -> DataFrame:
    """The vote that holds more than half of a key's votes."""
    counts = rows.where(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("total"), F.max_by(vote, F.struct("n", vote)).alias("winner"), F.max("n").alias("top"))
    return total.where(F.col("top") * 2 > F.col("total")).select(key, F.col("winner").alias(vote), F.col("top").alias("n"), "total")


def nearest_rank(rows: DataFrame, key: str, value: str, percent: float) -> DataFrame:
    """The nearest-rank percentile of each key, from counts of equal values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(key).orderBy(value)))
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    return upto.join(total, key).where(F.col("upto") >= F.ceil(F.lit(percent / 100) * F.col("total"))).groupBy(key).agg(F.min(value).alias("percentile"))


def ir_metrics(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Recall, precision, NDCG and reciprocal rank at k of ranked hits (query_id, doc_id, rank) against relevant pairs.

    Recall is 1 where nothing is relevant, NDCG 0 where its ideal is 0,
    precision 0 without results.
    """
    gold = relevant.select("query_id", "doc_id").distinct().withColumn("gold", F.lit(1))
    rows = hits.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(0)))
    got = rows.groupBy("query_id").agg(F.sum("gold").alias("found"), F.count(F.lit(1)).alias("n"), F.sum(F.col("gold") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
                                       F.min(F.when(F.col("gold") == 1, F.col("rank"))).alias("first"))
    some = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    both = got.join(some, "query_id", "full").na.fill(0, ["found", "n", "dcg", "relevant"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + F.when(i <= F.col("relevant"), 1 / F.log2(i + 1.0)).otherwise(0.0))
    return both.select("query_id", F.round(F.when(F.col("relevant") == 0, 1.0).otherwise(F.col("found") / F.col("relevant")), 6).alias("recall"),
                       F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.col("found") / F.col("n")), 6).alias("prec"),
                       F.round(F.when(F.col("relevant") == 0, 0.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg"),
                       F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def call_metrics(calls: DataFrame, name: str, succeeded: Column, latency: str) -> DataFrame:
    """(name, calls, succeeded, mean_latency) of the calls of each function."""
    return calls.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(succeeded).alias("succeeded"), F.round(F.avg(latency), 6).alias("mean_latency"))


def team_profile(rows: DataFrame, k: int = 10) -> DataFrame:
    """(team, n_members, n_items, value, n): size of each team (team, member, values) and its k most frequent values."""
    size = rows.groupBy("team").agg(F.count_distinct("member").alias("n_members"), F.count(F.lit(1)).alias("n_items"))
    counts = rows.select("team", F.explode("values").alias("value")).groupBy("team", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= k)
    return ranked.alias("c").join(size.alias("s"), F.col("c.team").eqNullSafe(F.col("s.team"))).select("s.team", "n_members", "n_items", "value", "n")
