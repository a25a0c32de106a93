import itertools
import random

import numpy as np
import pytest

from palimpsest.llm import jaccard_join as jj


def brute(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().translate(jj.UPPER).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in sets}


def results(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jj.similar_documents(df).collect()}


def copies(seed, n, edits):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.75:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, max(1, len(w) // edits))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice("abcdefghij")
            rows.append((i, " ".join(w[: len(w) - rng.randint(0, 2)])))
        else:
            rows.append((i, " ".join(rng.choice(["AA", "b", "c", "é", "f"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 80)))))
    return rows


@pytest.mark.parametrize("edits,block", [(25, 1024), (60, 5)])
def test_against_brute_force(docs_of, monkeypatch, edits, block):
    monkeypatch.setattr(jj._across, "__defaults__", (block,))
    rows = copies(edits, 500, edits)
    assert results(docs_of(rows)) == brute(rows)


def test_edges(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text.upper()), (7, "one two"), (8, "ONE\ttwo\n"), (9, None), (10, ""), (11, " \n"), (None, text), (3, "other words stand in this row here")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.similar_documents(docs_of([(*r, "x") for r in rows], ", class string")).collect()), key=repr)
    assert got == sorted([(5, 36, 3), (3, 36, 3), (7, 1, 7), (8, 1, 7), (9, 0, 9), (10, 0, 10), (11, 0, 11), (None, 36, None), (3, 3, 3)], key=repr)
    assert jj.similar_documents(docs_of([(1, "a")]).limit(0)).collect() == []


def test_similar_sets_share_a_signature_and_pass_the_sketch():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 7, 8, 13, 30, 63, 64, 65, 200, 700):
        for trial in range(20):
            core = rng.integers(0, 1 << 63, n).astype(np.uint64)
            a, b = core, core.copy()
            for _ in range(rng.integers(0, n // 7 + 2)):
                b[rng.integers(0, n)] = np.uint64(rng.integers(0, 1 << 63))
            b = b[: max(1, n - int(rng.integers(0, n // 8 + 1)))]
            a, b = np.unique(a), np.unique(b)
            if jj.similar(a, b):
                common = np.sort(rng.choice(core, n // 3)) if trial % 2 else np.empty(0, np.uint64)
                sig, who = jj.signatures([a, b], common)
                assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
                assert jj.may_link(len(a), jj.sketch(a), len(b), jj.sketch(b))


def test_possible_pairs_miss_no_link():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = sets[rng.integers(0, len(sets))] if sets and rng.random() < 0.8 else rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)
        new = np.unique(base[rng.random(len(base)) > 0.05])
        sets.append(new if len(new) else base)
    size, part = np.array([len(s) for s in sets]), np.arange(40)
    sk = [jj.sketch(s) for s in sets]
    links = {(a, b) for a, b in itertools.combinations(range(40), 2) if jj.similar(sets[a], sets[b])}
    everyone = np.arange(40)
    for left, right in ((everyone, everyone), (everyone[::2], everyone[1::2])):
        i, j, _ = jj.possible_pairs(size, sk, part, left, right)
        got = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got))
        want = links if left is right else {p for p in links if (p[0] + p[1]) % 2}
        assert want <= set(got)


def test_repeated_ids_get_the_component_of_their_own_text(docs_of):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near_a, near_b = a + " more", "more " + b
    for rows, want in (
        ([(5, a), (5, b), (7, near_a), (3, b)], [(3, 3), (5, 3), (5, 5), (7, 5)]),
        ([(5, a), (5, b), (3, near_a), (7, near_b)], [(3, 3), (5, 3), (5, 5), (7, 5)]),
    ):
        for order in (rows, rows[::-1]):
            assert sorted((r.doc_id, r.component_id) for r in jj.similar_documents(docs_of(order)).collect()) == want


def test_shingles_of_a_column_equal_those_of_plain_splits(monkeypatch):
    rng = random.Random(5)
    some = ["", None, " ", "one", "ONE two", "a b c d", "x" * 200, "é Ü " * 9, "\x1c a\x0bB\x85 c\x00 d e f\r\ng "]
    texts = [rng.choice(some) if rng.random() < 0.4 else "".join(rng.choice(["Aa", "b", " ", "\t", "é", "y" * 70, "Z "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    column = jj.pa.array(["dropped", *texts]).slice(1)
    keys: dict = {}
    for at_once in ((1 << 20, 1 << 16), (50, 3)):
        monkeypatch.setattr(jj, "BYTES_AT_ONCE", at_once[0])
        monkeypatch.setattr(jj, "WORDS_AT_ONCE", at_once[1])
        got = list(jj.shingle_sets(column))
        assert len(got) == len(texts)
        for t, s in zip(texts, got):
            w = (t or "").encode().translate(jj.UPPER).split()
            want = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
            assert len(s) == len(want) and (s[1:] > s[:-1]).all()
            assert keys.setdefault(want, s.tobytes()) == s.tobytes()
    assert len(set(keys.values())) == len(keys)


def test_no_part_is_signed_that_no_partner_needs():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, (1 << 64) - 1, n, np.uint64)) for n in (260, 300, 340) for _ in range(20)]
    sig, _ = jj.signatures(sets, np.empty(0, np.uint64))
    # three signatures bear two differences; a set may differ in a third of its size, and in two sevenths from those of the band below
    assert len(sig) < 1.05 * sum(len(s) for s in sets)
