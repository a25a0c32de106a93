import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import toxicity as tx


def all_segments(scored, drift):
    """Maximal scoring segments by their definition: best segment first, then both sides of it."""
    items = []
    last = -1
    for i, w in scored:
        if i - last > 1:
            items.append((None, -drift * (i - last - 1)))
        items.append((i, w))
        last = i

    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += items[b][1]
                if total > 1e-12 and (top is None or total > top[0] + 1e-12):
                    top = (total, a, b)
        if top is None:
            return []
        total, a, b = top
        return best(lo, a) + [(items[a][0], items[b][0], total)] + best(b + 1, hi)

    return best(0, len(items))


def test_segments_by_definition():
    rng = random.Random(1)
    for _ in range(300):
        at = sorted(rng.sample(range(40), rng.randint(0, 12)))
        scored = [(i, rng.choice([-3, -1.5, 0.7, 1.3, 2.9]) + rng.random() / 10) for i in at]
        got = tx.maximal_segments(scored, 0.21)
        want = all_segments(scored, 0.21)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def corpus(n):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefgh") + rng.choice("xyzuvw") + rng.choice("pqrst") for _ in range(rng.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "scoundrel", "wretchlike", "wretched"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, docs_of):
    rows, labels = corpus(1500)
    docs = docs_of(rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = marks.where(tx.fold_bucket("doc_id", 5) != 0)
    model = tx.train(docs, train.union(train))
    odd = docs_of([(5000, None, 1), (5001, "", 1), (5002, "  \n", 1), (5003, "VERMIN! vermin wretchling", 1), (None, "clean", 1), (5, "abc", 1), (5, "abc", 1)], ", score int")
    got = tx.score_documents(docs.unionByName(odd.drop("score")), model).collect()
    assert len(got) == 1507 and all(0 <= r.score <= 1 for r in got)
    held = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(r.score >= 0.5) == bool(held[r.doc_id]) for r in got if r.doc_id in held and r.doc_id != 5]
    assert sum(right) / len(right) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5003].score > 0.5 and len(by[5003].passages) >= 1
    assert by[5000].score < 0.5 and by[5001].score == by[5000].score
    assert tx.score_documents(odd.drop("score").limit(0), model).collect() == []


def test_nothing_to_learn_from(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    model = tx.train(docs, spark.createDataFrame([(1, 0, 0), (2, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int"))
    assert all(r.score < 0.5 for r in tx.score_documents(docs, model).collect())


def test_bounds(spark, docs_of):
    rows, labels = corpus(300)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tx.train(docs_of(rows), marks, tx.Settings(max_rows=100))
    assert 0 < len(model.weight)


def test_segments_in_linear_time():
    def took(n):
        scored = [(i, 1.0 if i % 2 == 0 else -1.5) for i in range(n)]
        began = time.perf_counter()
        tx.maximal_segments(scored, 0.05)
        tx.maximal_segments([(i, w + i * 1e-9) for i, w in scored], 0.05)
        return time.perf_counter() - began

    took(1000)
    assert min(took(80_000) for _ in range(3)) < 8 * min(took(20_000) for _ in range(3))


def plain_query(rows, labels, settings):
    """The whole query by its definitions: rows (id, score, passages)."""
    marks = {}
    for i, _, toxic in labels:
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 5:
            marks[i] = max(marks.get(i, 0), toxic)
    texts = {}
    for i, t in rows:
        if i in marks and t is not None:
            texts[i] = min(t, texts.get(i, t))
        elif i in marks:
            texts.setdefault(i, "")
    words_of = lambda t: tx.WORD((t or "").lower())
    seen = [Counter(), Counter()]
    for i, t in texts.items():
        own = set(words_of(t))
        seen[marks[i]].update(own | {w[:k] + "*" for w in own for k in (4, 5, 6) if len(w) > k})
    n0, n1 = (sum(c for t, c in s.items() if not t.endswith("*")) for s in seen)
    a0 = settings.prior * (n0 + n1)
    weight = {}
    for term in seen[0] | seen[1]:
        y0, y1 = seen[0][term], seen[1][term]
        a = settings.prior * (y0 + y1)
        w = math.log((y1 + a) / (n1 + a0 - y1 - a)) - math.log((y0 + a) / (n0 + a0 - y0 - a))
        if abs(w) / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= settings.min_z:
            weight[term] = w

    def segments(t):
        words = words_of(t)
        scored = []
        for i, word in enumerate(words):
            known = [x for x in [word] + [word[:k] + "*" for k in (6, 5, 4) if len(word) > k] if x in weight]
            if known:
                scored.append((i, weight[known[0]]))
        return len(words), all_segments(scored, settings.drift)

    clean = []
    train = []
    for i, t in texts.items():
        n, found = segments(t)
        train.append((marks[i], n, [s for *_, s in found]))
        if not marks[i] and found:
            clean.append((n, max(s for *_, s in found)))
    rate, base = 1.0, 0.0
    if len(clean) >= 20:
        q1, q3 = np.quantile([s for _, s in clean], [0.25, 0.75])
        rate = min(max((math.log(math.log(4)) - math.log(math.log(4 / 3))) / max(q3 - q1, 1e-3), 0.2), 2.0)
        base = float(np.median([rate * s - math.log(n) for n, s in clean])) + math.log(math.log(2))

    def evidence(n, scores):
        floor = max(0.0, base + math.log(max(n, 1)))
        over = [rate * s - floor for s in scores if rate * s > floor]
        x = sum(over) if over else max([rate * s - floor for s in scores], default=-8.0)
        return math.copysign(math.log1p(abs(x)), x)

    x = np.array([evidence(n, s) for _, n, s in train])
    y = np.array([m for m, *_ in train])
    mean, sd = x.mean(), x.std()
    b, best = np.zeros(2), None
    z = np.stack([np.ones_like(x), (x - mean) / sd], 1)
    for step in range(200_000):  # plain gradient descent
        g = z.T @ (1 / (1 + np.exp(-z @ b)) - y) + 1e-3 * b
        b -= 4.0 / len(x) * g
        if np.abs(g).max() < 1e-4:
            break
    out = []
    for i, t in rows:
        n, found = segments(t)
        floor = max(0.0, base + math.log(max(n, 1)))
        score = 1 / (1 + math.exp(-(b[0] + b[1] * (evidence(n, [s for *_, s in found]) - mean) / sd)))
        out.append((i, t, score, [(p, q) for p, q, s in found if rate * s > floor - math.log(0.01)]))
    return out


def test_whole_query_by_definition(spark, docs_of):
    rows, labels = corpus(600)
    rows = [(i, t if i % 7 else t.title() + "!") for i, t in rows] + [(3, "vermin again"), (3, "vermin again"), (None, "scoundrel"), (9000, None), (9001, "")]
    labels += [(3, 0, 1), (4, 1, None), (None, 1, 1)]
    labels = [(i, q, 1 - t if i is not None and t is not None and i % 13 == 0 else t) for i, q, t in labels]  # wrong marks: the classes overlap
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where(tx.fold_bucket("doc_id", 5) != 0)
    docs = docs_of(rows)
    model = tx.train(docs, marks)
    assert model.slope > 0
    got = [(r.doc_id, r.text, r.score, [(p.first, p.last) for p in r.passages]) for r in tx.score_documents(docs, model, keep=("doc_id", "text")).collect()]
    want = plain_query(rows, labels, tx.Settings())
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (x[0], x[1], x[3]) == (y[0], y[1], y[3])
        assert abs(x[2] - y[2]) < 1e-3


def test_many_labels(spark, docs_of):
    rng = random.Random(5)
    rows = []
    for i in range(26_000):
        words = [rng.choice("abcdefgh") + rng.choice("xyzuvw") for _ in range(rng.randint(5, 40))]
        if i % 10 == 0:
            words[1:1] = ["vermin", "scoundrel", "wretched"] * rng.randint(1, 3)
        rows.append((i, " ".join(words)))
    labels = [(i, 1, int(i % 10 == 0) if rng.random() > 0.02 else 1) for i, _ in rows]
    docs = docs_of(rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where(tx.fold_bucket("doc_id", 5) != 0)
    model = tx.train(docs, marks)
    assert model.slope > 0
    got = {r.doc_id: r.score for r in tx.score_documents(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 10 == 0) for i, _ in rows)


def test_fit_converges_on_hard_cases():
    rng = np.random.default_rng(1)
    for x, y in [
        (np.r_[np.zeros(18_000), np.full(2000, 8.0)], np.r_[np.zeros(18_000), np.ones(2000)]),  # apart, saturated
        (np.r_[rng.normal(-6, 0.1, 19_990), rng.normal(9, 0.1, 10)], np.r_[np.zeros(19_990), np.ones(10)]),
        (rng.normal(0, 1, 5000) + 1e4, (rng.random(5000) < 0.5).astype(float)),
    ]:
        intercept, slope = tx.fit_logistic(x, y)
        p = 1 / (1 + np.exp(-(intercept + slope * x)))
        assert abs(p.sum() - y.sum()) < 0.01 * len(x)
        if np.corrcoef(x, y)[0, 1] > 0.5:
            assert slope > 0 and ((p >= 0.5) == (y == 1)).all()
    with pytest.raises(ArithmeticError):
        tx.fit_logistic(x, y, rounds=0)
