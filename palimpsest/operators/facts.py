"""Facts with subject, relation and object: versioned merges that close what they replace, and decay by whole periods."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scoring
from palimpsest.operators import graph
from palimpsest.operators.writes import folded, trimmed
from palimpsest.sources.shared import written

FLOOR = 0.1
MOST_SOURCES = 50
FACT = ("id string, fact string, confidence double, project string, subject string, relation string, object string, strength double, n_access int, source_session_ids array<string>, "
        "is_latest boolean, superseded_by string, created_at timestamp, updated_at timestamp, accessed_at timestamp")

NAMES = [f.split()[0] for f in FACT.split(", ")]


class Merging:
    """Decides arriving facts against the live facts that share a text or a key with them."""

    def __init__(self, most_sources: int):
        self.most, self.live, self.changed, self.projects = most_sources, {}, set(), {}

    def take(self, row: dict) -> Iterator[dict]:
        self.projects.update(zip(row.pop("cited") or (), row.pop("cited_of") or ()))
        if row["stored"]:
            self.live[row["id"]] = row
            return
        key = (row["subject"], row["relation"])
        keyed = all((*key, row["object"]))
        same_key = [m for m in self.live.values() if keyed and m["project"] == row["project"] and (m["subject"], m["relation"]) == key]
        said = min((m for m in self.live.values() if m["low"] == row["low"] and m["project"] in (None, row["project"])), key=lambda m: m["id"], default=None)
        if said and keyed and not said["subject"] and any(self.projects.get(x) != row["project"] for x in said["source_session_ids"] or ()):
            said = None  # an unkeyed fact is keyed for a project only if all sessions that it cites are the project's
        target = said or min((m for m in same_key if m["object"] == row["object"]), key=lambda m: m["id"], default=None)
        action = "confirm" if target else "insert"
        if target:
            ids = [*(target["source_session_ids"] or []), *(row["source_session_ids"] or [])]
            kept = list(dict.fromkeys(ids[::-1]))[:self.most][::-1]
            target |= {"n_access": (target["n_access"] or 0) + 1, "accessed_at": row["at"], "updated_at": row["at"], "confidence": max(target["confidence"], row["confidence"]), "source_session_ids": kept}
            if keyed and not target["subject"]:
                target |= {c: row[c] for c in ("project", "subject", "relation", "object")}
        else:
            target = row | {"strength": row["confidence"], "n_access": 1, "is_latest": True, "superseded_by": None, "created_at": row["at"], "updated_at": row["at"], "accessed_at": row["at"]}
            if not keyed:
                target |= {c: None for c in ("project", "subject", "relation", "object")}
            self.live[target["id"]] = target
        self.changed.add(target["id"])
        for old in same_key:
            if old is not target and old["object"] != row["object"]:
                del self.live[old["id"]]
                action = "replace"
                yield self.written(old | {"is_latest": False, "superseded_by": target["id"], "updated_at": row["at"]})
        yield {"arrival": row["id"], "action": action, "target": target["id"]}

    def written(self, m: dict) -> dict:
        return {"fact": {c: m[c] for c in NAMES}}

    def end(self) -> Iterator[dict]:
        for m in self.live.values():
            if m["id"] in self.changed:
                yield self.written(m)


def merge_facts(facts: DataFrame, arrivals: DataFrame, sessions: DataFrame, most_sources: int = MOST_SOURCES) -> tuple[DataFrame, DataFrame]:
    """The facts after a batch of arrivals in order of (at, id), and (arrival, action, target) of each.

    ``facts`` has the columns of ``FACT``; ``arrivals`` id, fact, confidence, project, subject, relation, object,
    source_session_ids, at; ``sessions`` session_id, project.  Keys are trimmed and lower-cased, and count if all three parts are there.
    An arrival confirms the live fact of its text (of its project or of none), else that of its key and object, else it is a new
    fact.  Live facts of its key with another object are closed and name what replaced them.  An arrival whose id a fact already has is not taken
    again, so a batch that runs twice changes nothing.  Facts without a project meet arrivals by text only.
    """
    part = lambda c: F.nullif(F.lower(trimmed(F.coalesce(F.col(c), F.lit("")))), F.lit(""))
    known = written(facts.select("id"), "known-facts")  # as files of known size they may be broadcast, and arrivals stay where they are
    new = arrivals.join(known, "id", "left_anti").select(
        F.lit(False).alias("stored"), "id", trimmed(F.col("fact")).alias("fact"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "project",
        *[part(c).alias(c) for c in ("subject", "relation", "object")], "source_session_ids", F.col("at").cast("timestamp").alias("at"))
    old = facts.where("coalesce(is_latest, true)").select(F.lit(True).alias("stored"), *[f.split()[0] for f in FACT.split(", ")], F.lit(None).cast("timestamp").alias("at"))
    both = written(old.unionByName(new, allowMissingColumns=True), "facts")
    named = sessions.select(F.col("session_id").alias("session"), "project").where("project IS NOT NULL")
    cited = both.select("stored", "id", F.explode(F.array_distinct("source_session_ids")).alias("session")).join(named, "session")
    cited = cited.groupBy(F.col("stored").alias("_s"), F.col("id").alias("_i")).agg(F.collect_list(F.struct("session", "project")).alias("cited"))
    both = both.join(cited, (F.col("stored") == F.col("_s")) & (F.col("id") == F.col("_i")), "left").drop("_s", "_i")
    rows = both.withColumns({"low": F.lower("fact"), "_late": ~F.col("stored"), "cited": F.col("cited.session"), "cited_of": F.col("cited.project")})
    # a row is tied to its text and, if it has one, to its key
    tie = lambda *c: F.xxhash64(*c)
    rows = written(rows.withColumns({"_text": tie(F.lit("text"), "low"), "_key": F.when(F.col("subject").isNotNull() & F.col("relation").isNotNull() & F.col("object").isNotNull(),
                                                                                         tie(F.lit("key"), "project", "subject", "relation"))}), "facts")
    parts = graph.connected(rows.where("_key IS NOT NULL").select(F.col("_text").alias("src"), F.col("_key").alias("dst")).distinct())
    rows = rows.join(parts, F.col("_text") == F.col("node"), "left").withColumn("component", F.coalesce("component", "_text"))
    columns = ["stored", *[f.split()[0] for f in FACT.split(", ")], "cited", "cited_of", "at", "low", "_late"]
    done = folded(rows, ["_late", "at", "id"], columns, lambda: Merging(most_sources), f"arrival string, action string, target string, fact struct<{FACT}>")
    changed = done.where("fact IS NOT NULL").select("fact.*")
    more = [c for c in facts.columns if c not in changed.columns]
    changed = changed.join(facts.select("id", *more), "id", "left") if more else changed
    after = facts.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(*[F.col(c).cast(t).alias(c) for c, t in facts.dtypes]))
    return after, done.where("arrival IS NOT NULL").select("arrival", "action", "target")


def decay_periods(rows: DataFrame, now: Column, days: float, used: str = "accessed_at", updated: str = "updated_at", decayed: str = "decayed_at", strength: str = "strength") -> DataFrame:
    """Rows whose strength falls by a tenth for every whole idle period, down to the floor; ``decayed`` moves on by the periods applied.

    Periods count from the later of the last use and the last decay, so a second run at the same time changes nothing.
    """
    if days <= 0:
        return rows
    period = int(days * 86_400_000_000)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    since = F.greatest(micros(F.coalesce(used, updated)), micros(F.col(decayed)))
    periods = F.floor((micros(now) - since) / period)
    after = scoring.periodic_decay(F.col(strength), periods)
    changes = (periods >= 1) & (after != F.col(strength))
    moved = F.timestamp_micros(since + periods * period).cast(dict(rows.dtypes)[decayed])
    return rows.withColumns({strength: F.when(changes, after).otherwise(F.col(strength)), decayed: F.when(changes, moved).otherwise(F.col(decayed))})


def forgettable(rows: DataFrame, now: Column, days: float) -> DataFrame:
    """(id, updated_at) of rows at the floor that nobody used for ``days`` days."""
    idle = F.coalesce("accessed_at", "updated_at").cast("timestamp") < now.cast("timestamp") - F.make_dt_interval(F.lit(int(days)))
    return rows.where(F.lit(days > 0) & (F.col("strength") <= FLOOR) & (F.coalesce("n_access", F.lit(0)) == 0) & idle).select("id", "updated_at")


def due_projects(summaries: DataFrame, cursor: DataFrame, retry: DataFrame) -> DataFrame:
    """Projects with a summary since the cursor (last_run_at), and those to try again (project)."""
    since = cursor.agg(F.max("last_run_at").alias("last_run_at")).scalar()
    fresh = summaries.where((F.col("project") != "") & (F.col("created_at") > since))
    return fresh.select("project").unionByName(retry.select("project")).distinct()
