"""Batches of writes against saving their rows one by one."""
import datetime
import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from palimpsest.operators import similarity, writes

T0 = datetime.datetime(2024, 1, 1)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def words(t):
    return {w for w in re.split(r"\s+", t.lower()) if len(w) > 2}


def jaccard(a, b):
    x, y = words(a), words(b)
    if not x or not y:
        return 1.0 if a.split() == b.split() else 0.0
    return len(x & y) / len(x | y)


def fp(t):
    return hashlib.sha256(t.strip().lower().encode()).hexdigest()[:16]


def dates(t):
    return set(re.findall(r"\b\d{4}-\d{2}-\d{2}\b", t))


def test_copies_that_are_alike_cost_a_link_each(spark):
    rows = [(i, "g", "p", [f"w{j}" for j in range(40)] + [f"own{i}"]) for i in range(40)]
    rows += [(i, "g", None if i == 50 else "q", [f"v{j}" for j in range(40)] + [f"own{i}"]) for i in range(50, 53)] + [(60, "h", "p", rows[0][3])]
    links = similarity.ties(spark.createDataFrame(rows, "id long, group string, project string, words array<string>"), 0.7, "project").collect()
    parts = {i: i for i, *_ in rows}
    for link in links:
        old, new = sorted((parts[link.src], parts[link.dst]), reverse=True)
        parts = {i: new if p == old else p for i, p in parts.items()}
    assert parts == {i: 0 if i < 40 else 50 if i < 53 else 60 for i in parts}
    assert len(links) < 60


@pytest.mark.parametrize("masks, seen, lot, few", [(500_000, 1 << 20, 10, 16), (0, 8, 10**6, 1)])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, masks, seen, lot, few):
    """Whatever counts of words, masks and lots are used; scopes p, q and null, two groups, and rows beyond ``only``."""
    for name, value in (("MASKS", masks), ("SEEN", seen), ("LOT", lot), ("FEW", few)):
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(8)
    bases = [rng.sample(range(400), rng.choice([6, 10, 30])) for _ in range(12)]
    rows = []
    for i in range(160):
        own = list(rng.choice(bases))
        for _ in range(rng.randint(0, len(own) // 3)):
            own[rng.randrange(len(own))] = rng.randrange(400)
        rows.append((i * 37, rng.choice("gh"), rng.choice(["p", "q", None]), [f"w{w}" for w in set(own)]))
    asked = rows[:140]
    df = spark.createDataFrame(rows, "id long, group string, project string, words array<string>")
    links = similarity.ties(df, 0.7, "project", spark.createDataFrame([(r[0],) for r in asked], "id long")).collect()

    def reached(pairs):
        parts = {r[0]: r[0] for r in asked}
        for a, b in pairs:
            old, new = sorted((parts[a], parts[b]), reverse=True)
            parts = {i: new if p == old else p for i, p in parts.items()}
        return parts

    likeness = lambda a, b: len(set(a[3]) & set(b[3])) / len(set(a[3]) | set(b[3]))
    good = {(a[0], b[0]) for a in asked for b in asked if a[0] < b[0] and a[1] == b[1] and (a[2] == b[2] or None in (a[2], b[2])) and likeness(a, b) >= 0.7}
    assert {tuple(sorted((x.src, x.dst))) for x in links} <= good
    assert reached(good) == reached([(x.src, x.dst) for x in links]) and len(set(reached(good).values())) < 120


def test_remember_writes_texts_once(spark, monkeypatch, tmp_path):
    """What lies in the shared folder afterwards is at most 1.6 times the Parquet of the arrivals: texts, and keys and hashes beside them."""
    from palimpsest.sources import shared

    monkeypatch.setattr(shared, "shared_path", lambda spark, name: f"file://{tmp_path}/{name}-{random.random()}")
    rng = random.Random(9)
    texts = [" ".join(hashlib.sha256(f"{rng.randrange(40_000)}".encode()).hexdigest()[:12] for _ in range(500)) for _ in range(400)]
    rows = [(f"a{i:03}", t, "fact", "p", False, T0 + datetime.timedelta(seconds=i)) for i, t in enumerate(texts)]
    arrivals = spark.createDataFrame(rows, "id string, content string, type string, project string, global boolean, at timestamp").coalesce(1)
    arrivals.write.parquet(f"{tmp_path}-arrivals")
    after, _ = writes.remember(spark.createDataFrame([], writes.MEMORY), arrivals)
    assert after.count() == 400
    size = lambda top: sum(f.stat().st_size for f in top.rglob("*.parquet"))
    assert size(tmp_path) < 1.6 * size(tmp_path.with_name(f"{tmp_path.name}-arrivals"))


def remember_one_by_one(memories, arrivals):
    """(memories by id, actions) of plain loops over the whole store."""
    store, actions = {m["id"]: dict(m) for m in memories}, {}
    for a in sorted(arrivals, key=lambda a: (a["at"], a["id"])):
        project, everywhere = (a["project"] or "").strip() or None, bool(a["global"])
        if not (a["content"] or "").strip():
            actions[a["id"]] = ("reject: content is required", None)
            continue
        if project and everywhere:
            actions[a["id"]] = ("reject: project and global", None)
            continue
        fits = [m for m in store.values() if m["is_latest"] and bool(m["global"]) == everywhere and (not project or not m["project"] or m["project"] == project)]
        same = sorted((m for m in fits if m["project"] == project and fp(m["content"]) == fp(a["content"])), key=lambda m: m["id"])
        if same:
            same[0]["strength"] = min(10, same[0]["strength"] + 1)
            if a["type"] in writes.KINDS:
                same[0]["type"] = a["type"]
            actions[a["id"]] = ("reinforce", same[0]["id"])
            continue
        apart = lambda m: dates(m["content"]) and dates(a["content"]) and not dates(m["content"]) & dates(a["content"])  # noqa: E731, B023
        best = sorted((-jaccard(a["content"], m["content"]), m["id"]) for m in fits if not apart(m) and jaccard(a["content"], m["content"]) > 0.7)
        new = {"id": a["id"], "content": a["content"], "type": a["type"] if a["type"] in writes.KINDS else "fact", "project": project, "global": everywhere, "strength": 7, "version": 1, "parent_id": None, "is_latest": True}
        if best:
            old = store[best[0][1]]
            old["is_latest"] = False
            new |= {"version": old["version"] + 1, "parent_id": old["id"]}
        store[a["id"]] = new
        actions[a["id"]] = ("supersede", best[0][1]) if best else ("insert", None)
    return store, actions


def variant(rng, base):
    w = list(base)
    for _ in range(rng.randint(0, 2)):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return rng.choice([" ".join(w), " ".join(w).upper(), "  " + " ".join(w) + "\n"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_remember_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    bases = [rng.choices(WORDS, k=8) for _ in range(4)] + [["ab", "c"], ["2024-01-05", "daily", "report", "done"], ["2024-01-06", "daily", "report", "done"]]
    make = lambda i: {"id": f"a{i:03}", "content": rng.choice([variant(rng, rng.choice(bases)), None, " "]) if rng.random() < 0.1 else variant(rng, rng.choice(bases)),
                      "type": rng.choice(["fact", "bug", "nonsense", None]), "project": rng.choice([None, "p", "q", " p "]), "global": rng.choice([None, False, False, True]), "at": T0 + datetime.timedelta(seconds=rng.randint(0, 40))}
    arrivals = [make(i) for i in range(120)]
    memories = [{"id": f"m{i}", "content": variant(rng, bases[i % 4]), "type": "fact", "project": [None, "p"][i % 2], "global": False, "strength": 5 + i, "version": i + 1, "parent_id": None, "is_latest": i != 3,
                 "created_at": T0, "updated_at": T0, "title": f"t{i}"} for i in range(6)]
    want, actions = remember_one_by_one(memories, arrivals)
    stored = spark.createDataFrame(memories, writes.MEMORY + ", title string")
    after, done = writes.remember(stored, spark.createDataFrame(arrivals, "id string, content string, type string, project string, global boolean, at timestamp"))
    names = ["id", "content", "type", "project", "global", "strength", "version", "parent_id", "is_latest"]
    assert sorted(tuple(r) for r in after.select(*names).collect()) == sorted(tuple(m[n] for n in names) for m in want.values())
    assert {r.arrival: (r.action, r.target) for r in done.collect()} == actions
    assert {r.id: r.title for r in after.where("title IS NOT NULL").collect()} == {m["id"]: m["title"] for m in memories}
    assert {a for a, _ in actions.values()} >= {"insert", "reinforce", "supersede"}


def lessons_one_by_one(lessons, arrivals):
    store, actions = {m["id"]: dict(m) for m in lessons}, {}
    for a in sorted(arrivals, key=lambda a: (a["at"], a["id"])):
        content = (a["content"] or "").strip()
        if not content:
            actions[a["id"]] = ("reject: content is required", None)
            continue
        held = store.get(fp(content))
        if held is None or held["deleted"]:
            near = sorted((-jaccard(content, m["content"]), m["id"]) for m in store.values()
                          if not m["deleted"] and m["project"] in (None, a["project"]) and jaccard(content, m["content"]) >= 0.5)
            held = store[near[0][1]] if near else None
        if held is None:
            c = a["confidence"]
            store[fp(content)] = {"id": fp(content), "content": content, "context": (a["context"] or "").strip(), "confidence": c if c is not None and 0 <= c <= 1 else 0.5, "reinforcements": 0,
                                  "project": a["project"], "tags": a["tags"] or [], "deleted": False}
            actions[a["id"]] = ("created", fp(content))
            continue
        held["confidence"] = min(1.0, held["confidence"] + 0.1 * (1 - held["confidence"]))
        held["reinforcements"] += 1
        actions[a["id"]] = ("strengthened", held["id"])
        if held["content"] != content:
            actions[a["id"]] = ("restated", held["id"])
            held["content"] = content
            held["context"] = (a["context"] or "").strip() or held["context"]
            held["tags"] = list(dict.fromkeys([*held["tags"], *(a["tags"] or [])]))
        elif a["context"] and not held["context"]:
            held["context"] = a["context"]
    return store, actions


@pytest.mark.parametrize("seed", [1, 2])
def test_lessons_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    bases = [rng.choices(WORDS, k=6) for _ in range(5)] + [["go"]]
    arrivals = [{"id": f"a{i:03}", "content": variant(rng, rng.choice(bases)) if rng.random() > 0.05 else None, "context": rng.choice([None, "", " why ", "because"]), "confidence": rng.choice([None, 0.9, 7.0]),
                 "project": rng.choice([None, "p", "q"]), "tags": rng.choice([None, ["x"], ["y", "x"]]), "at": T0 + datetime.timedelta(seconds=rng.randint(0, 30))} for i in range(90)]
    texts = list(dict.fromkeys(variant(rng, b).strip() for b in bases[:4]))
    lessons = [{"id": fp(t), "content": t if i else "restated since " + t, "context": "", "confidence": 0.4, "reinforcements": 2, "project": [None, "q"][i % 2], "tags": [], "deleted": i == 2, "created_at": T0,
                "last_reinforced_at": None, "updated_at": T0} for i, t in enumerate(texts)]
    lessons = list({m["id"]: m for m in lessons}.values())
    want, actions = lessons_one_by_one(lessons, arrivals)
    after, done = writes.lesson_save(spark.createDataFrame(lessons, writes.LESSON), spark.createDataFrame(arrivals, "id string, content string, context string, confidence double, project string, tags array<string>, at timestamp"))
    names = ["id", "content", "context", "confidence", "reinforcements", "project", "tags", "deleted"]
    assert sorted((tuple(r) for r in after.select(*names).collect()), key=repr) == sorted((tuple(m[n] for n in names) for m in want.values()), key=repr)
    assert {r.arrival: (r.action, r.target) for r in done.collect()} == actions
    assert {a for a, _ in actions.values()} >= {"created", "strengthened", "restated"}


def test_unknown_projects_and_empty_tables(spark):
    kinds = "id string, content string, context string, confidence double, project string, tags array<string>, at timestamp"
    none = spark.createDataFrame([], writes.LESSON)
    new = spark.createDataFrame([("a", "some new lesson", None, None, "p", None, T0), ("b", "other words here", None, None, "nowhere", None, T0)], kinds)
    after, done = writes.lesson_save(none, new, spark.createDataFrame([("p",)], "project string"))
    assert sorted(tuple(r)[:2] for r in done.collect()) == [("a", "created"), ("b", "reject: unknown project")] and after.count() == 1
    after, done = writes.lesson_save(none, new.limit(0))
    assert after.count() == done.count() == 0
    after, done = writes.remember(spark.createDataFrame([], writes.MEMORY), spark.createDataFrame([], "id string, content string, type string, project string, global boolean, at timestamp"))
    assert after.count() == done.count() == 0


def test_one_wording_holds_a_third(spark):
    """Thousands of copies are one node of the links and one stream of the fold."""
    rows = [(f"a{i:05}", "the same words again and again" if i % 3 == 0 else f"own words {i} number {i * 7}", "fact", None, False, T0 + datetime.timedelta(seconds=i)) for i in range(3000)]
    arrivals = spark.createDataFrame(rows, "id string, content string, type string, project string, global boolean, at timestamp")
    after, done = writes.remember(spark.createDataFrame([], writes.MEMORY), arrivals)
    assert after.count() == 2001 and after.where("strength = 10").count() == 1
    assert done.where("action = 'reinforce'").count() == 999


def test_evolve_in_chains_and_forks(spark):
    kinds = "id string, title string, content string, version int, parent_id string, supersedes array<string>, is_latest boolean, created_at timestamp, updated_at timestamp, strength int"
    stored = spark.createDataFrame([("m", "t", "old", None, None, None, True, T0, T0, 7), ("n", "u", "other", 3, "x", ["x"], True, T0, T0, 2)], kinds)
    changes = spark.createDataFrame([("a", "m", "one", None, T0), ("b", "a", "two", "new title", T0), ("c", "a", "fork", "", T0), ("d", "nowhere", "?", None, T0), ("e", "d", "?", None, T0)], "id string, memory_id string, content string, title string, at timestamp")
    after, relations, errors = writes.evolve(stored, changes)
    got = {r.id: (r.title, r.content, r.version, r.parent_id, r.supersedes, r.is_latest, r.strength) for r in after.collect()}
    assert got == {"m": ("t", "old", None, None, None, False, 7), "n": ("u", "other", 3, "x", ["x"], True, 2), "a": ("t", "one", 2, "m", ["m"], False, 7),
                   "b": ("new title", "two", 3, "a", ["a", "m"], True, 7), "c": ("t", "fork", 3, "a", ["a", "m"], True, 7)}
    assert sorted(tuple(r)[:2] for r in relations.collect()) == [("a", "m"), ("b", "a"), ("c", "a")] and sorted(r.id for r in errors.collect()) == ["d", "e"]
    after, relations, _ = writes.evolve(stored, changes.limit(0))
    assert after.count() == 2 and relations.count() == 0


def test_trimmed_takes_what_the_expression_of_white_space_takes(spark):
    rows = [(f"{chr(c)}a{chr(c)}b{chr(c)}{chr(c)}",) for c in [*range(0x3100), 0xFEFF] if chr(c).isprintable() or c < 0x100 or 0x2000 <= c < 0x2070 or c in (0x1680, 0x180E, 0x3000)] + [("",), (" \n",), (None,), ("x \n",), ("\r\ny \n",)]
    df = spark.createDataFrame(rows, "v string")
    assert df.where(~writes.trimmed(F.col("v")).eqNullSafe(F.regexp_replace("v", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_times_reach_the_fold_as_numbers_and_come_back_as_times(spark):
    class Passing:
        def take(self, row):
            assert row["at"] is None or isinstance(row["at"], int)
            yield {"id": row["id"], "of": {"at": row["at"], "id": row["id"]}}

        def end(self):
            yield {"id": "end", "of": None}

    df = spark.sql("SELECT 1L AS component, cast(id AS string) AS id, if(id = 2, null, timestamp_micros(id * 1000001 - 3)) AS at FROM range(4)")
    got = writes.folded(df, ["id"], ["id", "at"], Passing, "id string, of struct<at timestamp, id string>")
    assert sorted((r.id, r.us) for r in got.where("of IS NOT NULL").selectExpr("id", "unix_micros(of.at) AS us").collect()) == [("0", -3), ("1", 999998), ("2", None), ("3", 3000000)]
    assert got.where("id = 'end' AND of IS NULL").count() == 1
