"""Facts, decay, images and the read-only predicate against plain loops."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import shell
from palimpsest.operators import facts, images

T0 = datetime.datetime(2024, 1, 1)
NAMES = [f.split()[0] for f in facts.FACT.split(", ")]
ARRIVAL = "id string, fact string, confidence double, project string, subject string, relation string, object string, source_session_ids array<string>, at timestamp"


def one_by_one(stored, arrivals, sessions, cap):
    store, actions = {m["id"]: dict(m) for m in stored}, {}
    known = {m["id"] for m in stored}
    for a in sorted(arrivals, key=lambda a: (a["at"], a["id"])):
        if a["id"] in known:
            continue
        s, r, o = ((a[c] or "").strip().lower() for c in ("subject", "relation", "object"))
        key, fact, p = bool(s and r and o), a["fact"].strip(), a["project"]
        live = [m for m in store.values() if m["is_latest"] is not False]
        same = [m for m in live if key and p is not None and m["project"] == p and m["subject"] == s and m["relation"] == r]
        said = sorted((m for m in live if m["fact"].lower() == fact.lower() and m["project"] in (None, p)), key=lambda m: m["id"])[:1]
        if said and key and not said[0]["subject"]:
            if any(sessions.get(x) != p for x in said[0]["source_session_ids"]):
                said = []
        hit = said or sorted((m for m in same if m["object"] == o), key=lambda m: m["id"])[:1]
        action = "confirm" if hit else "insert"
        if hit:
            t = hit[0]
            t["n_access"] += 1
            t["confidence"] = max(t["confidence"], a["confidence"] if a["confidence"] is not None else 0.5)
            t["source_session_ids"] = list(dict.fromkeys((t["source_session_ids"] + a["source_session_ids"])[::-1]))[:cap][::-1]
            if key and not t["subject"]:
                t |= {"project": p, "subject": s, "relation": r, "object": o}
        else:
            c = a["confidence"] if a["confidence"] is not None else 0.5
            t = store[a["id"]] = {"id": a["id"], "fact": fact, "confidence": c, "strength": c, "n_access": 1, "source_session_ids": a["source_session_ids"], "is_latest": True, "superseded_by": None,
                                  **({"project": p, "subject": s, "relation": r, "object": o} if key else dict.fromkeys(("project", "subject", "relation", "object")))}
        for old in same:
            if old is not t and old["object"] != o:
                old |= {"is_latest": False, "superseded_by": t["id"]}
                action = "replace"
        actions[a["id"]] = (action, t["id"])
    return store, actions


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_facts(spark, seed):
    rng = random.Random(seed)
    sessions = {f"s{i}": rng.choice(["p", "q"]) for i in range(5)}
    make = lambda i: {"id": f"a{i:03}", "fact": rng.choice(["Uses Go", "uses go", " Runs on 8080", "port is 9090", f"own {i}"]), "confidence": rng.choice([None, 0.3, 0.8]), "project": rng.choice(["p", "q"]),
                      "subject": rng.choice([None, "", "Service", " service "]), "relation": rng.choice(["port", "PORT", None]), "object": rng.choice(["8080", "9090", "7070"]),
                      "source_session_ids": rng.sample(sorted(sessions), 2), "at": T0 + datetime.timedelta(seconds=rng.randint(0, 60))}
    arrivals = [make(i) for i in range(70)]
    stored = [{"id": f"f{i}", "fact": ["uses go", "port is 9090", "old"][i % 3], "confidence": 0.5, "project": None if i % 2 else "p", "subject": None if i % 2 else "service", "relation": None if i % 2 else "port",
               "object": None if i % 2 else str(i), "strength": 0.5, "n_access": i, "source_session_ids": [["s0", "s1"], ["s2"], []][i % 3], "is_latest": i != 4, "superseded_by": None, "created_at": T0, "updated_at": T0, "accessed_at": T0} for i in range(6)]
    want, actions = one_by_one(stored, arrivals, sessions, 4)
    known = spark.createDataFrame(list(sessions.items()), "session_id string, project string")
    new = spark.createDataFrame(arrivals, ARRIVAL)
    after, done = facts.merge_facts(spark.createDataFrame(stored, facts.FACT), new, known, most_sources=4)
    names = ["id", "fact", "confidence", "project", "subject", "relation", "object", "strength", "n_access", "source_session_ids", "is_latest", "superseded_by"]
    assert {r.arrival: (r.action, r.target) for r in done.collect()} == actions
    assert sorted((tuple(r) for r in after.select(*names).collect()), key=repr) == sorted((tuple(m[n] for n in names) for m in want.values()), key=repr)
    assert {a for a, _ in actions.values()} == {"insert", "confirm", "replace"}
    inserted = {t for a, t in actions.values() if a == "insert"}
    again, done = facts.merge_facts(after, new.where(F.col("id").isin(*inserted)), known, most_sources=4)
    assert done.count() == 0 and sorted(map(repr, again.collect())) == sorted(map(repr, after.collect()))


def test_decay_by_whole_periods(spark):
    day = lambda n: T0 + datetime.timedelta(days=n)
    rows = [("a", 1.0, day(0), day(0), None), ("b", 1.0, day(20), day(0), None), ("c", 0.1, day(0), day(0), None), ("d", 1.0, None, day(0), day(15)), ("e", 0.105, day(0), day(0), None)]
    df = spark.createDataFrame(rows, "id string, strength double, accessed_at timestamp, updated_at timestamp, decayed_at timestamp")
    once = facts.decay_periods(df, F.lit(day(25)), 10)
    got = {r.id: (round(r.strength, 6), r.decayed_at) for r in once.collect()}
    assert got == {"a": (0.81, day(20)), "b": (1.0, None), "c": (0.1, None), "d": (0.9, day(25)), "e": (0.1, day(20))}
    assert sorted(facts.decay_periods(once, F.lit(day(25)), 10).collect()) == sorted(once.collect())
    assert {r.id: round(r.strength, 6) for r in facts.decay_periods(once, F.lit(day(30)), 10).collect()} == {"a": 0.729, "b": 0.9, "c": 0.1, "d": 0.9, "e": 0.1}
    assert facts.decay_periods(df, F.lit(day(25)), 0) is df
    idle = once.withColumn("n_access", F.when(F.col("id") == "c", 0).otherwise(F.lit(None)))
    assert sorted(r.id for r in facts.forgettable(idle, F.lit(day(100)), 30).collect()) == ["c", "e"]
    assert facts.forgettable(idle, F.lit(day(100)), 0).count() == 0


def test_due_projects(spark):
    summaries = spark.createDataFrame([("p", T0), ("q", T0 + datetime.timedelta(days=2)), (None, T0 + datetime.timedelta(days=2)), ("", T0 + datetime.timedelta(days=2))], "project string, created_at timestamp")
    cursor = spark.createDataFrame([(T0 + datetime.timedelta(days=1),)], "last_run_at timestamp")
    retry = spark.createDataFrame([("r",), ("q",)], "project string")
    assert sorted(r.project for r in facts.due_projects(summaries, cursor, retry).collect()) == ["q", "r"]


def test_reference_counts(spark):
    rng = random.Random(3)
    counts = {"a": 2, "b": 1, "c": 5, "z": 4}
    deltas = [(rng.choice("abcdef"), rng.choice([1, -1, -1]), T0 + datetime.timedelta(seconds=rng.randint(0, 20)), i) for i in range(80)]
    want, gone = dict(counts), set()
    for path, d, _, _ in sorted(deltas, key=lambda x: (x[2], str(x[3]))):
        want[path] = max(0, want.get(path, 0) + d)
    gone = {p for p, n in want.items() if n == 0 and any(x[0] == p for x in deltas)}
    after, dead = images.count_references(spark.createDataFrame(list(counts.items()), "path string, n long"), spark.createDataFrame(deltas + [(None, 1, T0, 99), ("a", None, T0, 98)], "path string, delta int, at timestamp, id int"))
    assert {r.path: r.n for r in after.collect()} == {p: n for p, n in want.items() if n}
    assert {r.path for r in dead.collect()} == gone


@pytest.mark.parametrize("quota", [0, 55, 120, 10_000])
def test_quota_spares_referenced_and_fresh(spark, quota):
    rng = random.Random(4)
    now = T0 + datetime.timedelta(days=5)
    rows = [(f"i{i:02}", rng.randint(1, 30), T0 + datetime.timedelta(hours=rng.randint(0, 119))) for i in range(30)] + [("fresh", 9, now - datetime.timedelta(seconds=5))]
    held = {"i03", "i07", "i20"}
    total, want = sum(s for _, s, _ in rows), set()
    for path, size, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if total > quota and path not in held and (now - at).total_seconds() >= 30:
            want.add(path)
            total -= size
    got = images.over_quota(spark.createDataFrame(rows, "path string, size int, changed_at timestamp"), spark.createDataFrame([(p, 1) for p in held] + [("i05", 0)], "path string, n int"), quota, F.lit(now))
    assert {r.path for r in got.collect()} == want


@pytest.mark.parametrize("command, good", [
    ("ls -la | grep x && cat a.txt", True), ("cat 'a; rm b' \"c\\\"d\"", True), ("git log --oneline 2>/dev/null", True), ("git -C /x --no-pager diff", True), ("git branch -a", True),
    ("git branch new", False), ("git push", False), ("git", False), ("git grep -Oless x", False), ("git diff --output=f", False), ("echo hi > f", False), ("echo hi >&2", True), ("echo `rm x`", False),
    ("echo \"$(rm x)\"", False), ("echo '$(rm x)'", True), ("echo \"\\$(x)\"", True), ("echo $'x'", False), ("cat <(ls)", False), ("cat 'open", False), ("cat \"open", False), ("rm x", False), ("/usr/bin/cat x", True), ("/bin/rm x", False),
    ("find . -name x", True), ("find . -delete", False), ("sort -o f x", False), ("sort -n x", True), ("uniq a b", False), ("uniq -c a", True), ("uniq -- a", False), ("rg --pre x y", False), ("", False), (None, False), ("  ;; ", False),
    ("cd x; ls\nwc -l", True), ("ls; rm x", False), ("ls & rm x", False), ("tree -o f", False), ("ls \\; rm", True), ("cat a\\ b", True), ("toString", False), ("echo &> /dev/null", True)])
def test_read_only_commands(command, good):
    assert shell.reads_only(command) is good


def test_read_only_calls(spark):
    rows = [("post_tool_use", "Read", None, "ok", True), ("post_tool_use", "Bash", "ls", None, True), ("post_tool_use", "Bash", "ls", '{"stderr": "x"}', False), ("post_tool_use", "Bash", None, "", False),
            ("post_tool_use", "Edit", "ls", "", False), ("pre_tool_use", "Read", None, "", False), (None, "Read", None, "", False), ("post_tool_use", None, "ls", "", False), ("post_tool_use", "Grep", None, '"is_error": true', False)]
    df = spark.createDataFrame(rows, "hook string, tool string, command string, output string, want boolean")
    assert df.where(shell.read_only_call(F.col("hook"), F.col("tool"), F.col("command"), F.col("output")) != F.col("want")).count() == 0
