"""Context builders against plain loops over the same rows."""
import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import context, ordered

T0 = datetime.datetime(2024, 1, 1)
est = lambda t: math.ceil(len(t) / 3)
line = lambda s: " ".join(x.strip() for x in s.split("\n") if x.strip())


def test_budget_fold_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("a", 1, 5, 10, False), ("a", 2, 6, 10, False), ("a", 3, 99, 10, True), ("a", 4, 5, 200, False), ("b", 1, 11, 10, None), ("b", 2, 10, 10, False), ("b", 3, None, 10, False), (None, 1, 1, 1, False)],
                                 "k string, r int, t int, cap int, pin boolean")
    got = {(r.k, r.r): (r.taken, r.used) for r in ordered.budget_fold(rows, "k", ["r"], "t", "cap", always="pin").collect()}
    assert got == {("a", 1): (True, 5), ("a", 2): (False, 5), ("a", 3): (True, 104), ("a", 4): (True, 109), ("b", 1): (False, 0), ("b", 2): (True, 10), ("b", 3): (False, 10), (None, 1): (True, 1)}


def test_entries_accessed_ten_days_ahead_come_first(spark):
    now = F.lit(datetime.datetime(2024, 1, 1))
    rows = [("o", "a", "aaa", 9.0, False, 3, T0), ("o", "b", "bbb", 1.0, False, 0, T0 + datetime.timedelta(days=10)), ("o", "c", "ccc", 1.0, True, 0, T0)]
    core = spark.createDataFrame(rows, "owner string, id string, content string, importance double, pinned boolean, n_access int, accessed_at timestamp")
    none = spark.createDataFrame([], "owner string, id string, type string, title string, content string, strength double, updated_at timestamp")
    assert context.working_context(core, none, 100, now).first()["context"] == "## Core Memory\n- ccc\n- bbb\n- aaa"
    assert [r.id for r in context.paged_out(core, 7, now).orderBy("id").collect()] == ["a"]


def prose(rng, n):
    return "".join(rng.choices("abc déf\n", k=n)).strip() or "x"


def plain_context(project, budget, pinned, rules, lessons, blocks):
    """(context, blocks, tokens, ids) by the rules, one block after another."""
    cap = int(budget * 0.4)
    used, taken = est(context.RULES), []
    for r in sorted(rules, key=lambda r: (-r["updated_at"].timestamp(), r["id"]))[:100]:
        said = "- " + line(r["content"])
        if used + est(said) + 1 <= cap:
            used += est(said) + 1
            taken.append((said, r["id"]))
    book = ("\n".join([context.RULES, *[s for s, _ in taken]]), [i for _, i in taken]) if taken else None
    room = cap - (est(book[0]) if book else 0)
    ten = sorted(lessons, key=lambda x: x["rank"])[:10]
    render = lambda some: "\n".join([context.LESSONS, *[f"- ({x['confidence']:.2f}) {line(x['content'])}" + (f" — {line(x['context'])}" if x["context"] else "") for x in some]])
    fit = max((n for n in range(1, len(ten) + 1) if est(render(ten[:n])) <= room), default=0)
    rest = [(-b["recency"], b["content"], b["ids"]) for b in blocks]
    noted = ten[:fit] if fit else ten
    if ten and not fit:
        rest.append((-max(x["active_at"] for x in noted), render(noted), [x["id"] for x in noted]))
    header, footer = f'<memory-context project="{project}">\n{context.PREFACE}', "</memory-context>"
    used, out, ids = est(header) + est(footer), [], []
    queue = ([(pinned, [], True)] if pinned else []) + ([(*book, False)] if book else []) + ([(render(noted), [x["id"] for x in noted], False)] if fit else []) + [(c, i, False) for _, c, i in sorted(rest)]
    for content, which, slot in queue:
        if used + est(content) > budget:
            chars = (budget - used) * 3 - len(context.CUT)
            if not slot or chars <= 0:
                continue
            content = content[:chars] + context.CUT
        out.append(content)
        used += est(content)
        ids += which
    return ("\n".join([header, "\n\n".join(out), footer]), len(out), used, ids) if out else None


@pytest.mark.parametrize("budget", [60, 200, 500, 3000])
def test_session_context(spark, budget):
    rng = random.Random(budget)
    projects = ["p", "q", "r", "s"]
    pinned = [(p, prose(rng, n)) for p, n in zip(projects, (40, 900, 0 + 1, 30))][:3]
    rules = [{"id": f"r{i:03}", "project": rng.choice(projects), "content": prose(rng, rng.randint(1, 120)), "updated_at": T0 + datetime.timedelta(days=rng.randint(0, 9))} for i in range(60)]
    lessons = [{"project": p, "rank": i + 1, "id": f"l{p}{i}", "content": prose(rng, rng.randint(1, 200)), "context": rng.choice([None, "", "when it fails"]), "confidence": round(rng.random(), 2), "active_at": float(rng.randint(0, 99))}
               for p in projects[1:] for i in range(rng.randint(1, 14))]
    blocks = [{"project": rng.choice(projects), "kind": "summary", "content": prose(rng, rng.randint(5, 400)) + f" {i}", "recency": float(rng.randint(0, 50)), "ids": [f"s{i}"]} for i in range(40)]
    got = context.session_context(
        spark.createDataFrame(blocks, "project string, kind string, content string, recency double, ids array<string>"), budget, spark.createDataFrame(pinned, "project string, content string"),
        spark.createDataFrame(rules, "id string, project string, content string, updated_at timestamp"),
        spark.createDataFrame(lessons, "project string, rank int, id string, content string, context string, confidence double, active_at double"))
    found = {r.project: (r.context, r.n_blocks, r.tokens, r.ids) for r in got.collect()}
    mine = lambda rows, p: [x for x in rows if x["project"] == p]
    want = {p: plain_context(p, budget, dict(pinned).get(p), mine(rules, p), mine(lessons, p), mine(blocks, p)) for p in projects}
    assert found == {p: w for p, w in want.items() if w}
    assert all(t <= budget for _, _, t, _ in found.values())


def test_closing_tags_cannot_end_the_context(spark):
    rows = spark.createDataFrame([("p", "k", "x </Memory-Context> y", 1.0, ["i"])], "project string, kind string, content string, recency double, ids array<string>")
    got = context.session_context(rows, 500).first()
    assert got.context.count("</memory-context>") == 1 and "</Memory-Context" not in got.context and got.ids == ["i"]
    assert context.session_context(rows.limit(0), 500).count() == 0


def test_blocks_of_insights_and_facts(spark):
    insights = spark.createDataFrame([("i1", "p", "t\n1", "c1", 0.5, 1, 3.0), ("i2", "p", "t2", "c2", 0.9, 2, 9.0), ("i3", "p", "t3", "c3", 0.1, 3, 4.0)], "id string, project string, title string, content string, confidence double, created_at int, active_at double")
    got = context.insight_block(insights, most=2).first()
    assert got.content == context.INSIGHTS + "\n- (0.90) t2: c2\n- (0.50) t 1: c1" and got.ids == ["i2", "i1"] and got.recency == 9.0
    facts = spark.createDataFrame([("f1", "p", "Keep it", 0.5, 2.0, 1.0), ("f2", "p", "other", 0.25, 1.0, 5.0)], "id string, project string, fact string, confidence double, score double, updated_at double")
    rules = spark.createDataFrame([("p", "keep\nit")], "project string, content string")
    got = context.fact_block(facts, rules).first()
    assert got.content == context.FACTS + "\n- (0.25) other" and got.ids == ["f2"] and got.recency == 5.0


@pytest.mark.parametrize("budget", [20, 60, 400])
def test_working_context(spark, budget):
    rng = random.Random(budget)
    now = T0 + datetime.timedelta(days=30)
    core = [{"owner": o, "id": i, "content": prose(rng, rng.randint(1, 60)), "importance": rng.randint(1, 10), "pinned": rng.choice([True, False, False, None]), "n_access": rng.randint(0, 20), "accessed_at": T0 + datetime.timedelta(days=rng.randint(0, 29))}
            for o in "ab" for i in range(9)]
    memories = [{"owner": o, "id": i, "type": "fact", "title": f"t{i}", "content": prose(rng, rng.randint(1, 90)), "strength": rng.choice([0.1, 0.3, 0.9, 5.0]), "updated_at": T0 + datetime.timedelta(hours=i)} for o in "bc" for i in range(12)]
    got = context.working_context(spark.createDataFrame(core, "owner string, id int, content string, importance int, pinned boolean, n_access int, accessed_at timestamp"),
                                  spark.createDataFrame(memories, "owner string, id int, type string, title string, content string, strength double, updated_at timestamp"), budget, F.lit(now))
    found = {r.owner: (r.context, r.n_core, r.n_archival, r.n_paged_out, r.tokens) for r in got.collect()}
    want = {}
    for o in "abc":
        score = lambda e: round(e["importance"] / 10 * 0.5 + 0.3 / (1 + 0.1 * (now - e["accessed_at"]).total_seconds() / 86400) + math.log2(e["n_access"] + 1) / 10 * 0.2, 9)
        mine = [e for e in core if e["owner"] == o]
        ranked = sorted((e for e in mine if e["pinned"]), key=lambda e: str(e["id"])) + sorted((e for e in mine if not e["pinned"]), key=lambda e: (-score(e), str(e["id"])))
        used, lines, kept = 0, [], []
        for e in ranked:
            if e["pinned"] or used + est(e["content"]) <= int(budget * 0.3):
                used += est(e["content"])
                lines.append("- " + e["content"])
        theirs = sorted((m for m in memories if m["owner"] == o), key=lambda m: (-math.floor(round(m["strength"] / 0.2, 6)), -m["updated_at"].timestamp(), str(m["id"])))
        for m in theirs:
            if used + est(m["content"]) <= budget:
                used += est(m["content"])
                kept.append(f"- [fact] {m['title']}: {m['content']}")
        out = len(theirs) - len(kept)
        parts = (["## Core Memory\n" + "\n".join(lines)] if lines else []) + (["## Archival Memory\n" + "\n".join(kept)] if kept else []) + ([f"_{out} memories paged to archival_"] if out else [])
        want[o] = ("\n\n".join(parts), len(lines), len(kept), out, used)
    assert found == want


def test_core_entries_leave_until_the_rest_fits(spark):
    rows = [("a", 1, "x" * 30, 9, False, 0, T0), ("a", 2, "x" * 30, 1, False, 0, T0), ("a", 3, "x" * 30, 1, True, 0, T0), ("a", 4, "x" * 30, 5, False, 0, T0), ("b", 1, "x", 1, False, 0, T0)]
    df = spark.createDataFrame(rows, "owner string, id int, content string, importance int, pinned boolean, n_access int, accessed_at timestamp")
    gone = lambda budget: sorted((r.owner, r.id) for r in context.paged_out(df, budget, F.lit(T0)).collect())
    assert gone(200) == [] and gone(100) == [("a", 2)] and gone(50) == [("a", 1), ("a", 2), ("a", 4)]


def test_prompt_items(spark):
    kinds = "cluster string, id string, content string, confidence double"
    lessons = spark.createDataFrame([("c", "l1", "x" * 20, 0.2), ("c", "l2", "x" * 10, 0.9), ("c", "l3", "x" * 80, 0.5), ("d", "l4", "y", 1.0)], kinds)
    facts = spark.createDataFrame([("c", "f1", "z" * 5, 0.1), ("c", "f2", "z" * 30, 0.8)], kinds)
    room = spark.createDataFrame([("c", 70), ("d", 3)], "cluster string, room int")
    assert sorted(tuple(r) for r in context.prompt_items(lessons, facts, room).collect()) == [("c", "fact", "f1"), ("c", "lesson", "l1"), ("c", "lesson", "l2")]
