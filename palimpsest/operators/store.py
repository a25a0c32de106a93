"""Reading and changing keyed tables: lookups, scopes, deletes, unions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row for each distinct key asked for; columns are null where there is no such row."""
    return keys.select(key).distinct().join(rows, key, "left")


def scopes_by_prefix(rows: DataFrame, scope: str, prefix: str) -> DataFrame:
    return rows.where(F.startswith(F.col(scope), F.lit(prefix))).select(scope).distinct()


def scopes_with_key(rows: DataFrame, scope: str, key: str, value: object) -> DataFrame:
    """The scopes that hold a key."""
    return rows.where(F.col(key) == F.lit(value)).select(scope).distinct()


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows without those whose key is listed."""
    return rows.join(gone.select(key), key, "left_anti")


def conditional_delete(rows: DataFrame, gone: DataFrame, key: str, updated: str, expected: str) -> DataFrame:
    """Rows without the listed ones whose time is still the expected one."""
    listed = gone.select(F.col(key).alias("_k"), F.col(expected).alias("_e"))
    return rows.join(listed, (F.col(key) == F.col("_k")) & F.col(updated).eqNullSafe(F.col("_e")), "left_anti")


def forget(observations: DataFrame, memories: DataFrame, ids: DataFrame | None = None, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations and memories without the listed ids (id) and all of the listed sessions (session_id)."""
    if ids is not None:
        observations, memories = delete(observations, ids, "id"), delete(memories, ids, "id")
    if sessions is not None:
        observations, memories = delete(observations, sessions, "session_id"), delete(memories, sessions, "session_id")
    return observations, memories


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def first_by_key(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """Of rows with the same normalised key the first one."""
    return rows.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_r = 1").drop("_k", "_r")


def last_distinct(old: Column, new: Column, cap: int) -> Column:
    """The union of two arrays where the last occurrence of a value stays, cut to the last ``cap``."""
    distinct = F.array_distinct(F.reverse(F.concat(old, new)))
    return F.reverse(F.slice(distinct, 1, cap))


def in_several(lists: DataFrame, item: str, least: int = 2) -> DataFrame:
    """Items that occur in several rows' lists (owner, item)."""
    return lists.select("owner", item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def joint_corpus(observations: DataFrame, memories: DataFrame) -> DataFrame:
    """Observations and the memories as documents of one corpus."""
    return observations.unionByName(memory_documents(memories), allowMissingColumns=True)


def memory_documents(memories: DataFrame) -> DataFrame:
    """Memories as documents: content is narrative and only fact, strength the importance."""
    return memories.select("id", "session_id", F.col("created_at").alias("ts"), F.lit("decision").alias("type"), "title", F.array("content").alias("facts"), F.col("content").alias("narrative"),
                           "concepts", F.col("strength").alias("importance"), "agent_id")


def lesson_documents(lessons: DataFrame, slim: bool = False) -> DataFrame:
    """Lessons as documents: title is the head of the content; ``slim`` leaves out facts that repeat the narrative."""
    facts = F.array("content")
    facts = F.when(F.col("content").eqNullSafe(F.col("context")), F.array().cast("array<string>")).otherwise(facts) if slim else facts
    return lessons.select("id", F.left("content", F.lit(120)).alias("title"), facts.alias("facts"), F.col("context").alias("narrative"), F.col("tags").alias("concepts"))
