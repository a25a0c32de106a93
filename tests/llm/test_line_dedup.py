import hashlib
import re
import string

from palimpsest.llm import line_dedup as ld

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least=10):
    keys = lambda t: [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(LOWER) for x in (t or "").split("\n")]
    n = {}
    for _, t in rows:
        for k in set(keys(t)):
            n[k] = n.get(k, 0) + 1
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if not k or n[k] < least]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def results(df, **more):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in ld.dedup_lines(df, **more).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=repr)


def test_against_brute_force(docs_of):
    rows = [(i, "\n".join([f"own {i}", " Common\t" if i % 2 else "cOMMON", "É" if i % 3 else "é", "", "nine" if i < 9 else "x", "twice", "twice" if i < 5 else ""])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "common"), (103, "twice\nother"), (None, "common\nmine"), (104, "line\r\n" * 3000)]
    assert results(docs_of(rows)) == brute(rows)


def test_batches_and_clashing_columns(docs_of):
    rows = [(i, f"a\nb{i % 4}\nc{i}") for i in range(48)]
    for batches in (1, 3, 8):
        assert results(docs_of(rows), batches=batches) == brute(rows)
    assert results(docs_of([(*r, 1) for r in rows], ", h1 int")) == brute(rows)
    assert ld.dedup_lines(docs_of(rows).limit(0)).collect() == []


def test_runs_are_compacted(spark, docs_of):
    runs = ld.LineRuns(spark, min_docs=2)
    for k in range(4):
        runs.add(ld.document_keys(docs_of([(k, "same"), (k + 10, f"only {k}")]), "text", []))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.frequent().count() == 1
