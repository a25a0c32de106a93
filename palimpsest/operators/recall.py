"""Composed recall: enrichment, scoped search, lessons, insights, facts, skills, files and context.

Hits are rows (query_id, id, score); every order ends with the id, and every scope is
applied before a floor or limit.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring, text
from palimpsest.operators import fusion, similarity
from palimpsest.sources.shared import written


# ---------------------------------------------------------------- joins


def enrich(hits: DataFrame, observations: DataFrame, memories: DataFrame, columns: list[str]) -> DataFrame:
    """Hits with the columns of their record: the observation with the id, else the memory; others go."""
    o = observations.select(F.col("id").alias("_o"), F.struct(*columns).alias("_a"))
    m = memories.select(F.col("id").alias("_m"), F.struct(*columns).alias("_b"))
    rows = hits.join(o, F.col("id") == F.col("_o"), "left").join(m, F.col("id") == F.col("_m"), "left").withColumn("_v", F.coalesce("_a", "_b"))
    return rows.where("_v IS NOT NULL").select(*hits.columns, "_v.*")


def session_projects(ids: DataFrame, sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """(session_id, project) of the session, else its summary, else one of its own, which no project has."""
    s = sessions.select("session_id", F.col("project").alias("_sp"))
    u = summaries.select("session_id", F.col("project").alias("_up"))
    rows = ids.select("session_id").distinct().join(s, "session_id", "left").join(u, "session_id", "left")
    return rows.select("session_id", F.coalesce("_sp", "_up", F.concat(F.lit("\0"), F.col("session_id").cast("string"))).alias("project"))


def covering_summary(observations: DataFrame, summaries: DataFrame) -> DataFrame:
    """Observations with the summary of their session that covers them (null: none does).

    A summary covers what is older than ``covered_through``, or, where that isn't known, what is
    not newer than itself.
    """
    u = summaries.select(F.col("session_id").alias("_s"), "summary_id", "covered_through", F.col("created_at").alias("_at"))
    covers = F.when(F.col("covered_through").isNotNull(), F.col("ts") < F.col("covered_through")).otherwise(F.col("ts") <= F.col("_at"))
    return observations.join(u, (F.col("session_id") == F.col("_s")) & covers, "left").select(*observations.columns, "summary_id")


def citations(memories: DataFrame, observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """(memory_id, observation_id, session_id, project) for each source of a memory that is found."""
    each = memories.select(F.col("id").alias("memory_id"), F.explode(F.array_distinct("sources")).alias("observation_id"))
    o = observations.select(F.col("id").alias("observation_id"), "session_id")
    return each.join(o, "observation_id").join(sessions.select("session_id", "project"), "session_id", "left").select("memory_id", "observation_id", "session_id", "project")


def facts_in_project(facts: DataFrame, sessions: DataFrame, project: str, every: bool = False) -> DataFrame:
    """Facts (id, sessions) that cite a session of a project; with ``every`` all their known sessions are of it."""
    cited = facts.select("id", F.explode(F.array_distinct("sessions")).alias("session_id")).join(sessions.select("session_id", "project"), "session_id")
    mine = F.coalesce(F.col("project") == project, F.lit(False))
    found = cited.groupBy("id").agg((F.bool_and(mine) if every else F.bool_or(mine)).alias("ok")).where("ok")
    return facts.join(found.select("id"), "id", "left_semi")


def commits_with_sessions(commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """(sha, session_id, project) for each known session that a commit lists."""
    return commits.select("sha", F.explode(F.array_distinct("sessions")).alias("session_id")).join(sessions.select("session_id", "project"), "session_id")


def best_per_session(hits: DataFrame) -> DataFrame:
    """The best hit of each query and session."""
    order = Window.partitionBy("query_id", "session_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def amendment(hits: DataFrame, own_session: str, share: float = 0.35, lead: float = 1.25) -> DataFrame:
    """(query_id, id, session_id, score): the decision of another session that may amend a query's own.

    Of the best hits of each session the first of another session must reach a share of the own
    session's and lead the next one.  ``own_session`` names the column of the own session.
    """
    best = best_per_session(hits)
    own = F.coalesce(F.max(F.when(F.col("session_id") == F.col(own_session), F.col("score"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    others = best.withColumn("_own", own).where(F.col("session_id") != F.col(own_session))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = others.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order)).where("_r = 1")
    good = (F.col("score") >= share * F.col("_own")) & (F.col("_next").isNull() | (F.col("score") >= lead * F.col("_next")))
    return ranked.where(good).select("query_id", "id", "session_id", "score")


# ---------------------------------------------------------------- terms


def split_terms(query: Column, longer_than: int) -> Column:
    """Distinct lower-case words cut at white space, longer than ``longer_than``."""
    return text.word_set(query, longer_than)


def semantic_terms(query: Column) -> Column:
    """Distinct words of two characters and more without punctuation at their edges and stop words."""
    words = F.split(F.lower(F.coalesce(query, F.lit(""))), r"[ \t\n\r\f\x0B]+")
    bare = F.transform(words, lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_except(F.array_distinct(F.filter(bare, lambda t: F.char_length(t) > 1)), F.array(*[F.lit(w) for w in text.STOP_WORDS]))


def term_share(queries: DataFrame, terms: Column, rows: DataFrame, body: Column, starts: bool = False) -> DataFrame:
    """(query_id, id, matched, n_terms): how many terms of each query occur in a row's text, rows with none left out.

    A term occurs as a part of a word of the text, with ``starts`` at the start of a run of letters
    and digits.  Rows and terms meet on such words: words of the rows are listed once, and those
    that hold a term are found among the distinct words, not among the rows.
    """
    asked = queries.select("query_id", terms.alias("_terms")).withColumn("n_terms", F.size("_terms")).select("query_id", "n_terms", F.explode("_terms").alias("term"))
    cut = r"[^\p{L}\p{N}]+" if starts else r"[ \t\n\r\f\x0B]+"
    words = rows.select("id", F.explode(F.array_distinct(F.split(F.lower(body), cut))).alias("word")).where("word <> ''")
    if starts:  # a term with punctuation inside is looked for by its leading run, then in the text
        lead = F.regexp_extract("term", r"^[\p{L}\p{N}]+", 0)
        tails = words.select("word").distinct().select("word", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda n: F.left("word", n))).alias("head"))
        found = asked.withColumn("head", lead).join(tails, "head").join(words, "word").select("query_id", "n_terms", "term", "id", (F.col("head") == F.col("term")).alias("_plain")).distinct()
        inner = found.where("NOT _plain").join(rows.select("id", F.lower(body).alias("_text")), "id").where(
            F.expr(r"_text RLIKE concat('(^|[^\\p{L}\\p{N}])\\Q', replace(term, '\\E', '\\E\\\\E\\Q'), '\\E')")).drop("_text")
        found = found.where("_plain").unionByName(inner).drop("_plain")
    else:
        tails = words.select("word").distinct().select("word", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda n: F.substring("word", n, F.lit(1 << 20)))).alias("tail"))
        grams = tails.select("word", "tail", F.left("tail", F.lit(2)).alias("head")).where("char_length(tail) >= 2")
        found = asked.withColumn("head", F.left("term", F.lit(2))).join(grams, "head").where("startswith(tail, term)").select("query_id", "n_terms", "term", "word").distinct()
        found = found.join(words, "word").select("query_id", "n_terms", "term", "id").distinct()
    return found.groupBy("query_id", "n_terms", "id").agg(F.count(F.lit(1)).alias("matched"))


# ---------------------------------------------------------------- recalls


def lesson_recall(hits: DataFrame, lessons: DataFrame, project: str | None = None, least: float = 0.0, k: int = 10) -> DataFrame:
    """(query_id, id, score): confidence times the share of the best lexical score, fading with days unused.

    ``hits`` are lexical hits; ``lessons`` have id, project, confidence and days since last use.  Lessons
    without a project belong to all.
    """
    share = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    rows = hits.withColumn("_share", share).join(lessons, "id").where(F.col("confidence") >= least)
    if project:
        rows = rows.where(F.col("project").isNull() | (F.col("project") == project))
    scored = rows.select("query_id", "id", F.round(scoring.aged(F.col("confidence"), F.col("_share"), F.col("days")), 3).alias("score"))
    return best(scored, k)


def lesson_rank(lessons: DataFrame, project: str) -> DataFrame:
    """(id, score) for context: lessons of the project count half as much again."""
    weight = F.when(F.col("project") == project, 1.5).otherwise(1.0)
    return lessons.select("id", F.round(scoring.aged(F.col("confidence"), weight, F.col("days")), 6).alias("score"))


def share_recall(matched: DataFrame, rows: DataFrame, weight: str, days: str | None = None, k: int = 10) -> DataFrame:
    """(query_id, id, score): a weight times the matched share of terms, fading with ``days`` if given."""
    share = F.col("matched") / F.col("n_terms")
    each = matched.join(rows, "id")
    score = F.col(weight) * share if days is None else scoring.aged(F.col(weight), share, F.col(days))
    return best(each.select("query_id", "id", F.round(score, 6).alias("score")), k)


def share_search(queries: DataFrame, terms: Column, rows: DataFrame, body: Column, weight: str, days: str | None = None, starts: bool = False, k: int = 10) -> DataFrame:
    """``share_recall`` of ``term_share``: (query_id, id, score) of rows (id, weight, days and what ``body`` uses).

    Queries meet distinct texts.  The k weightiest rows of each text give the kth best score of each query, and only rows
    that reach it are dealt by query.
    """
    rows = rows.select("id", F.col(weight).alias("weight"), *([F.col(days).alias("days")] if days else []), F.lower(body).alias("text"))
    matched = term_share(queries, terms, rows.select(F.col("text").alias("id")).distinct(), F.col("id"), starts)
    matched = written(matched.select("query_id", F.col("id").alias("text"), (F.col("matched") / F.col("n_terms")).alias("share")), "matched-texts")
    score = lambda share: F.col("weight") * share if days is None else scoring.aged(F.col("weight"), share, F.col("days"))
    first = Window.partitionBy("text").orderBy(score(F.lit(1.0)).desc(), "id")
    tops = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).join(matched, "text").select("query_id", "id", F.round(score(F.col("share")), 6).alias("score"))
    least = best(tops, k).groupBy("query_id").agg(F.when(F.count("score") == k, F.min("score")).alias("_least"))
    asked = written(matched.join(least, "query_id"), "matched-texts")
    hits = rows.join(asked, "text").select("query_id", "id", F.round(score(F.col("share")), 6).alias("score"), "_least")
    return best(hits.where(F.col("_least").isNull() | (F.col("score") >= F.col("_least"))).drop("_least"), k)


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def newest_first_within_title(hits: DataFrame, title: Column, claimed: str) -> DataFrame:
    """Hits of one title keep their places and scores, but the newest takes the best.

    ``hits``: query_id, id, score and the columns used; ties in time: the better hit first.
    """
    key = F.lower(F.trim(title))
    group = lambda *order: Window.partitionBy("query_id", "_title").orderBy(*order)
    rows = hits.withColumn("_title", key)
    places = rows.select("query_id", "_title", F.col("score").alias("_score"), F.row_number().over(group(F.desc("score"), "id")).alias("_n"))
    newest = rows.withColumn("_n", F.row_number().over(group(F.desc(claimed), F.desc("score"), "id"))).drop("score")
    return newest.join(places, ["query_id", "_title", "_n"]).withColumnRenamed("_score", "score").drop("_title", "_n").select(*hits.columns)


# ---------------------------------------------------------------- searches


def page(hits: DataFrame, records: DataFrame, k: int, shadow_kind: str | None = "kind") -> DataFrame:
    """The last steps of a search: newer records move above those they repeat, then the best k of each query.

    ``hits`` are limited and above the floor; ``records`` (id, ts, kind, body).
    """
    ranked = hits.select("query_id", F.col("id").alias("doc_id"), "score").transform(fusion.ranked)
    if shadow_kind:
        pool = ranked.join(records.select(F.col("id").alias("doc_id"), "ts", "kind", "body"), "doc_id")
        newer = similarity.shadowing(pool).select("query_id", F.col("newer_id").alias("doc_id"), F.col("doc_id").alias("shadows"))
        newer = newer.groupBy("query_id", "doc_id").agg(F.min("shadows").alias("shadows"))
        placed = fusion.lift_shadowing(ranked.join(newer, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", "shadows"))
        ranked = placed.join(ranked.drop("rank"), ["query_id", "doc_id"])
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("doc_id").alias("id"), F.col("rank").cast("int").alias("rank"), "score")


def file_context(files: DataFrame, observations: DataFrame, touched: DataFrame, recent: DataFrame, least: int = 4, k: int = 5) -> DataFrame:
    """(file, id, importance, rank): for each file the most important observations of recent sessions that touched it.

    ``touched`` (want, path) pairs a wanted file with the paths that name it, ``observations`` have
    id, session_id, importance and files, ``recent`` the newest sessions (session_id, recency: 1 is the newest).
    """
    each = observations.where(F.col("importance") >= least).select("id", "session_id", "importance", F.explode(F.array_distinct("files")).alias("path"))
    hits = each.join(recent, "session_id").join(touched, "path").select(F.col("want").alias("file"), "id", "importance", "recency").distinct()
    hits = hits.join(files.select("file").distinct(), "file", "left_semi")
    order = Window.partitionBy("file").orderBy(F.desc("importance"), "recency", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("file", "id", "importance", "rank")


def session_highlights(observations: DataFrame, k: int = 5) -> DataFrame:
    """The most important, then newest, observations of each session that have a title and a narrative."""
    rows = observations.where("title IS NOT NULL AND title <> '' AND trim(narrative) <> ''")
    order = Window.partitionBy("session_id").orderBy(F.desc("importance"), F.desc("ts"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context_blocks(sessions: DataFrame, summaries: DataFrame, highlights: DataFrame, newest: int = 10) -> DataFrame:
    """(project, session_id, kind, content, tokens, rank) of a project's newest sessions: their summary, else their highlights."""
    order = Window.partitionBy("project").orderBy(F.desc("started_at"), "session_id")
    recent = sessions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= newest).select("project", "session_id", "started_at", "rank")
    lines = highlights.select("session_id", F.struct("rank", F.concat(F.lit("- ["), "type", F.lit("] "), "title", F.lit(": "), "narrative").alias("line")).alias("l"))
    shown = lines.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x.line), "\n").alias("shown"))
    rows = recent.join(summaries.select("session_id", F.col("body").alias("summary")), "session_id", "left").join(shown, "session_id", "left")
    rows = rows.withColumn("kind", F.when(F.col("summary").isNotNull(), "summary").when(F.col("shown").isNotNull(), "observation")).where("kind IS NOT NULL")
    content = F.concat(F.lit("## Session "), F.col("session_id").cast("string"), F.lit("\n"), F.coalesce("summary", "shown"))
    return rows.select("project", "session_id", "kind", content.alias("content"), text.token_estimate(content).alias("tokens"), "rank")
