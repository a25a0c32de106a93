import hashlib
import random
import re

import pytest

from palimpsest.llm import decontaminate as dc


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            v = words(it)
            for k in range(max(1, len(v) - 9)) if v else ():
                win = v[k : k + 10]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [(100_000, 100_000), (3, 100_000), (3, 2)])
def test_against_brute_force(spark, docs_of, sent):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["a", "B", "c1", "é", "ÄB", "x-y", "the"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(12)] + [(20, None), (21, "!!"), (2, "rare words only here now and then one two three"), (22, "a")]
    docs = [(i, " ".join([say(rng.randint(0, 12)), rng.choice(items)[1] or "", say(rng.randint(0, 12)), rng.choice(items)[1] or ""])) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "word " * 5000)]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = dc.summarised(dc.find_contamination(docs_of([(*d, 1) for d in docs], ", n_hit int"), df, sent_windows=sent[0], sent_words=sent[1]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    docs = docs_of([(1, "one two"), (1, "one two"), (None, "x")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_items for r in dc.summarised(dc.find_contamination(docs, none)).collect()] == [0, 0, 0]
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert dc.find_contamination(docs.limit(0), items).collect() == []
    assert sorted(r.n_hit for r in dc.summarised(dc.find_contamination(docs, items)).collect()) == [0, 1, 1]


@pytest.mark.parametrize("sent", [(100_000, 100_000), (3, 100_000), (3, 2)])
def test_repeated_and_null_ids(spark, sent):
    docs = [(1, "a b"), (1, "c d"), (1, "c d"), (None, "e f"), (None, "x y"), (None, "x y")]
    items = [(i, w) for i, w in enumerate("a c e g h".split())]
    df = spark.createDataFrame([(*d, {"k": 1}) for d in docs], "doc_id long, text string, extra map<string,int>").repartition(3)
    found = dc.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), sent_windows=sent[0], sent_words=sent[1], keep=["doc_id", "text", "extra"])
    assert sorted((tuple(r) for r in dc.summarised(found).collect()), key=repr) == brute(docs, items)
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted(docs, key=repr)
