import hashlib
import random

import numpy as np
import pytest
from helpers import by_id, clashing, docs

from netloom.llm import minhash, repeats
from netloom.llm.components import components


def _sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def _near(rows):
    sets, parent = _sets(rows), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def _corpus(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "É one two three four"),
            (1006, "é one two three four"), (1007, "z " * 30_000), (1008, "Z " * 20_000)]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(n):  # a hub with many copies of all degrees, chains, and strangers
        own = list(base) if i % 3 else [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
        if i % 3 == 0:
            base = base[3:] + [rng.choice(words) for _ in range(3)]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates_match_brute_force(spark, block):
    rows = _corpus(5)
    got = minhash.near_duplicates(clashing(docs(spark, rows)), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == _near(rows)


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (None, "only here now"), (8, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (7, 5, False), (None, None, True), (8, 8, True)], key=str)
    assert minhash.near_duplicates(docs(spark, rows).limit(0)).collect() == []
    df = clashing(docs(spark, rows[3:4] + rows[:1]))
    assert minhash.keep(df).columns == df.columns


def test_rows_without_or_with_repeated_ids_stay_apart(spark):
    long = [f"w{i}" for i in range(60)]
    a, near_a = " ".join(long), " ".join(long[:-1] + ["end"])
    b, near_b = " ".join(reversed(long)), " ".join(list(reversed(long))[:-1] + ["end"])
    rows = [(1, a), (None, a.upper()), (None, "clean row without an id"), (None, b), (None, near_b),
            (4, "one text of a shared id"), (4, near_a), (9, "another one, on its own"), (9, None)]
    left = [(r.doc_id, r.text) for r in minhash.keep(clashing(docs(spark, rows))).collect()]
    assert sum((None, t) in left for t in (b, near_b)) == 1
    want = [(1, a), (None, rows[2][1]), (4, rows[5][1]), (9, rows[7][1]), (9, None)]
    assert sorted((x for x in left if x[1] not in (b, near_b)), key=str) == sorted(want, key=str)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 900).astype(np.uint64)) for _ in range(2))
    one, two = np.concatenate((a, b[:100])), np.concatenate((a, b[100:200]))
    left, right = minhash.sketch(one, 1024), minhash.sketch(two, 1024)
    assert (minhash.sketch(np.union1d(one, two), 1024) == minhash.merge(left, right)).all()
    assert abs((left == right).mean() - len(np.intersect1d(one, two)) / len(np.union1d(one, two))) < 0.06
    up, down = (left > right).sum(), (left < right).sum()
    assert minhash.plausible([up], [down], [1024 - up - down], [1000], [1000], 0.75)[0]
    far = minhash.sketch(b, 1024)
    up, down = (left > far).sum(), (left < far).sum()
    assert not minhash.plausible([up], [down], [1024 - up - down], [1000], [900], 0.75)[0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 199: 199, 200: 199}


def _repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = [True] * length
            seen.add(b[s:s + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 20, 150])
def test_repeats_match_brute_force(spark, monkeypatch, piece):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdéf ") for _ in range(n))
    common = [word(300) for _ in range(3)]
    rows = [(None, common[0]), (0, None), (1, ""), (2, "x" * 99), (3, "x" * 500), (4, "ab" * 400), (5, "é" * 60), (6, "é" * 61)]
    for i in range(10, 60):
        at, n = rng.randrange(200), rng.randrange(60, 300)
        rows.append((i, word(rng.randrange(80)) + rng.choice(common)[at:at + n] + word(rng.randrange(200)) + rng.choice(common)))
    rows += [(70, rows[20][1]), (71, common[1] * 4)]
    monkeypatch.setattr(repeats, "PIECE", piece)
    for parts in (1, 5):
        got = repeats.remove_repeats(clashing(docs(spark, rows, parts)))
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == _repeats(rows, 100)


def test_repeats_with_repeated_ids(spark):
    text = "some words that are quite long " * 3 + "0123456789" * 4
    rows = [(1, text), (1, text), (1, "a" + text), (2, text)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs(spark, rows)).collect())
    n = len(text)
    assert got == [(1, n, n), (1, n + 1, 0), (2, n, n)]
    assert repeats.remove_repeats(docs(spark, rows).limit(0)).collect() == []
    assert by_id(repeats.remove_repeats(docs(spark, [(4, text)])))[4].n_removed == 0
