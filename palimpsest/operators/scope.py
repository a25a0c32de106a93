"""Which rows a reader may see: scopes, layers, floors and list filters.

Filters are conditions or left joins on keys; none limits rows before it filters.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text

HARNESS = "task-notification|teammate-message|cross-session-message|agent-message"  # elements that a harness writes: fixed values
# Words that name nothing to search for: fixed values.
TERSE_STOP = (
    "the and for that this with you your are was were have has had not but can could would should will just from they them then than into about what when where "
    "which while there their here also its our out all any more some been being does did doing done get got make made use using please want need like let's lets "
    "one two now still"
).split()


def latest_only(rows: DataFrame, flag: str = "is_latest") -> DataFrame:
    """Rows that aren't marked as replaced; no mark counts as latest."""
    return rows.where(F.coalesce(F.col(flag), F.lit(True)))


def not_excluded(rows: DataFrame, tool: str, prefixes: list[str]) -> DataFrame:
    """Rows whose tool starts with none of the prefixes; rows without a tool stay."""
    name = F.coalesce(F.col(tool), F.lit(""))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | name.startswith(p)
    return rows.where(~hit)


def in_project(hits: DataFrame, project: str, memories: DataFrame, sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Hits (id, session_id) that belong to a project.

    A global memory always does.  Else the project of the session decides, then that of the
    memory (id, project, is_global), then that of the summary; where none is known the hit stays.
    ``sessions`` and ``summaries`` have session_id and project.
    """
    m = memories.select(F.col("id").alias("_m"), F.col("project").alias("_mp"), F.col("is_global").alias("_g"))
    s = sessions.select(F.col("session_id").alias("_s"), F.coalesce("project", F.lit("")).alias("_sp"))
    u = summaries.select(F.col("session_id").alias("_u"), F.col("project").alias("_up"))
    rows = hits.join(m, F.col("id") == F.col("_m"), "left").join(s, F.col("session_id") == F.col("_s"), "left").join(u, F.col("session_id") == F.col("_u"), "left")
    mine = F.coalesce("_sp", "_mp", F.when(F.col("_up") != "", F.col("_up")))
    return rows.where(F.coalesce("_g", F.lit(False)) | mine.isNull() | (mine == project)).select(*hits.columns)


def agent_of(asked: str | None, isolated: bool, own: str | None) -> str | None:
    """The agent that a reader's rows are limited to; None: no limit.

    A named agent counts before the reader's own; ``*`` asks for all.  An isolated reader that
    names none and has none is refused.
    """
    asked = (asked or "").strip() or None
    if asked == "*":
        return None
    found = asked or (own if isolated else None)
    if isolated and not found:
        raise PermissionError("isolated reader without an agent; ask for '*' to read all")
    return found


def by_agent(rows: DataFrame, agent: str | None, orphans: bool = False) -> DataFrame:
    """Rows of an agent, with ``orphans`` also those of none."""
    if agent is None:
        return rows
    return rows.where((F.col("agent_id") == agent) | (F.lit(orphans) & F.col("agent_id").isNull()))


def by_cwd(hits: DataFrame, sessions: DataFrame, cwd: str) -> DataFrame:
    """Hits whose session ran in a directory, or isn't known."""
    other = sessions.where(~F.col("cwd").eqNullSafe(F.lit(cwd))).select("session_id")
    return hits.join(other, "session_id", "left_anti")


def by_layer(hits: DataFrame, layer: str, is_memory: Column) -> DataFrame:
    """Scored hits of a layer: memory, observation or all."""
    if layer not in ("memory", "observation", "all"):
        raise ValueError(f"no such layer: {layer}")
    return hits if layer == "all" else hits.where(is_memory == F.lit(layer == "memory"))


def prompt_floor(hits: DataFrame, session: Column, injected: DataFrame, least: float = 5.0, share: float = 0.5) -> DataFrame:
    """Hits of other sessions near the best of them, with a narrative, not injected before.

    ``injected`` has id; the best score of a query counts the hits of other sessions only.
    """
    earlier = hits.where(~F.col("session_id").eqNullSafe(session))
    best = F.max("score").over(Window.partitionBy("query_id"))
    strong = earlier.withColumn("_best", best).where((F.col("score") >= F.greatest(F.lit(least), share * F.col("_best"))) & (F.coalesce(F.col("narrative"), F.lit("")) != "")).drop("_best")
    return strong.join(injected.select("id").distinct(), "id", "left_anti")


def governance(memories: DataFrame, project: str | None = None, kinds: list[str] | None = None, since: object = None, until: object = None, below: float | None = None) -> DataFrame:
    """Memories that all conditions given hold for; at least one must be given."""
    tests = [F.col("project") == project] if project else []
    tests += [F.col("type").isin(kinds)] if kinds else []
    tests += [F.col("created_at") >= F.lit(since)] if since is not None else []
    tests += [F.col("created_at") <= F.lit(until)] if until is not None else []
    tests += [F.col("strength") < below] if below is not None else []
    if not tests:
        raise ValueError("at least one condition is needed")
    for t in tests:
        memories = memories.where(t)
    return memories


def memory_page(memories: DataFrame, project: str | None = None, agent: str | None = None, orphans: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the latest memories of a project or of all projects, newest first."""
    rows = by_agent(latest_only(memories), agent, orphans)
    if project:
        rows = rows.where((F.col("project") == project) | F.coalesce("is_global", F.lit(False)))
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def commit_page(commits: DataFrame, branch: str | None = None, repo: str | None = None, limit: int = 100) -> DataFrame:
    """The newest linked commits of a branch and repository, 500 at most."""
    for column, value in (("branch", branch), ("repo", repo)):
        commits = commits.where(F.col(column) == value) if value else commits
    return commits.orderBy(F.desc("linked_at"), "sha").limit(min(limit, 500))


def branch_sessions(sessions: DataFrame, root: str) -> DataFrame:
    """Sessions whose project or directory is a repository's root or lies below it."""
    inside = lambda c: (F.col(c) == root) | F.col(c).startswith(root.rstrip("/") + "/")
    return sessions.where(F.coalesce(inside("project"), F.lit(False)) | F.coalesce(inside("cwd"), F.lit(False)))


def is_harness_message(prompt: Column) -> Column:
    """Text made only of elements that a harness writes; one without an end counts as well."""
    start = rf"<({HARNESS})[\s>]"
    trimmed = F.regexp_replace(F.coalesce(prompt, F.lit("")), r"^\s+|\s+$", "")
    rest = F.regexp_replace(trimmed, rf"\G{start}[\s\S]*?</\1>\s*", "")
    return trimmed.rlike("^" + start) & ((rest == "") | rest.rlike("^" + start))


def content_tokens(prompt: Column) -> Column:
    """Distinct tokens of three characters and more that name something."""
    found = F.regexp_extract_all(F.lower(F.coalesce(prompt, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9_./-]*[a-z0-9]|[a-z0-9]"), F.lit(0))
    return F.array_except(F.filter(found, lambda t: F.char_length(t) >= 3), F.array(*[F.lit(w) for w in TERSE_STOP]))


def is_terse(prompt: Column, below: int = 3) -> Column:
    return F.size(content_tokens(prompt)) < below


def has_keyword(keyword: str, *columns: str) -> Column:
    """The keyword, in any case, occurs in one of the text columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(keyword.lower()))
    return hit


def scrubbed(rows: DataFrame, *columns: str) -> DataFrame:
    """Secrets replaced in the named columns."""
    return rows.withColumns({c: text.scrub(F.col(c)) for c in columns})
