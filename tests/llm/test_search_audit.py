import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import by_id, clashing, docs

from netloom.llm import divergence, lexical, simhash
from netloom.llm.queries import ORACLES

# ---- SimHash


def _print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _linked(prints, distance=4):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints.items():
        for j, b in prints.items():
            if i < j and (a ^ b).bit_count() <= distance:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in prints}


def _texts(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, "\t \n"), (903, "One two"), (904, "one  TWO"), (905, "É a b c"), (906, "é a b c"),
            (907, "x " * 50_000)]
    base = [rng.choices(words, k=rng.randint(20, 200)) for _ in range(12)]
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    return rows


def test_simhash_against_brute_force(spark):
    rows = _texts(1)
    want = {i: _print(t) for i, t in rows}
    parts = _linked(want)
    got = by_id(simhash.near_duplicates(clashing(docs(spark, rows))))
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == want
    assert {i: r["component_id"] for i, r in got.items()} == parts
    assert len(set(parts.values())) < len(rows) - 20


def test_slices_of_a_long_text_change_nothing():
    rng = random.Random(2)
    text = " ".join(rng.choices(["a", "bb", "ccc", "Dé"], k=5000)).encode()
    assert {simhash.fingerprint(text, size=s) for s in (1, 7, 100, 1 << 20)} == {_print(text.decode())}


@pytest.mark.parametrize("pieces,order", [(simhash.PIECES, 4), (((32, 2), (32, 1)), 5), (((16, 1), (16, 0), (16, 0), (16, 0)), 3)])
def test_every_linked_pair_meets_at_an_anchor(pieces, order):
    rng = np.random.default_rng(3)
    simhash.check_pieces(pieces, order, 4)
    one = rng.integers(0, 2**64, 300, dtype=np.uint64)
    two = one.copy()
    for row in range(300):
        for bit in rng.choice(64, 4, replace=False):
            two[row] ^= np.uint64(1) << np.uint64(bit)
    met, low = np.zeros(300, bool), 0
    for bits, threshold in pieces:
        cut = lambda x: (x >> np.uint64(low)) & np.uint64((1 << bits) - 1)  # noqa: B023, E731
        home, _, _ = simhash.anchors(cut(one), bits, threshold, order)
        _, row, visit = simhash.anchors(cut(two), bits, threshold, order)
        assert (np.bitwise_count(visit ^ cut(two)[row]) <= 1 + threshold).all()
        met[row[visit == home[row]]] = True
        low += bits
    assert met.all()


def test_pieces_that_could_lose_a_pair_are_refused():
    with pytest.raises(ValueError):
        simhash.check_pieces(((22, 1), (21, 0), (21, 0)), 4, 4)


def test_blocks_of_a_large_anchor_keep_the_components(spark):
    rng = random.Random(4)
    prints = {0}
    while len(prints) < 400:  # few bits differ: nearly all meet at the same anchors
        prints.add(sum(1 << b for b in rng.sample(range(0, 63, 3), rng.randint(0, 5))))
    want = _linked({p: p for p in prints})
    frame = spark.createDataFrame([(p,) for p in prints], "print bigint")
    links = [tuple(r) for r in simhash.links(frame, homes=16, visitors=64).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    assert len(links) < 400 * 399 / 2
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {p: find(p) for p in prints} == want


def test_simhash_repeats_nulls_and_empty(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, None), (7, ""), (8, "other words are here now")]
    got = sorted((str(r["doc_id"]), r["fingerprint"] == "0" * 16, r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect())
    assert got == [("5", False, 5), ("5", False, 5), ("7", True, 7), ("8", False, 8), ("None", False, 5), ("None", True, 7)]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0

# ---- Divergence of sources


def _oracle(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"_{name}", frame.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    return sorted(map(str, con.execute(sql).fetchall()))


def _audit_rows(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Élan", "élan", "x9y", "don't", "gamma", "delta", "日本"]
    rows = []
    for i in range(160):
        text = rng.choice([None, "", "... 12", *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(9)]])
        rows.append((i, text, rng.choice(["en", "fr", "a b", None]), rng.choice(["s1", "s2", "s 3", None, ""]), 1))
    rows += [(500, "lonely", "xx", "s1", 1), (501, None, "xx", "s2", 1), (502, "solo", "yy", "s1", 1), (503, "gamma " * 30_000, "en", "s1", 1),
             (503, "gamma " * 30_000, "en", "s1", 1), (None, "beta gamma", "fr", "s2", 1)]
    return rows


@pytest.mark.parametrize("sources_tile,terms_tile,size", [(64, 4096, 1 << 26), (2, 3, 1 << 26), (1, 1, 0)])
def test_divergence_against_sql(spark, sources_tile, terms_tile, size):
    frame = spark.createDataFrame(_audit_rows(5), "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    want = _oracle(ORACLES["op12_source_divergence"], documents=frame)
    got = divergence.audit(clashing(frame).withColumn("terms", frame["text"]), vocabulary_text=size, sources_tile=sources_tile, terms_tile=terms_tile)
    got = got.select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(str(tuple(r)) for r in got) == want and any("'term'" in w for w in want)
    assert sum(r["lang"] == "xx" and r["value"] == 0 for r in got) == 2


def test_divergence_ranks_and_empty(spark):
    rows = [(i, " ".join(f"t{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(40 if i % 2 else 0, 300)), "en", f"s{i % 2}", 1) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = divergence.audit(frame, ranks=30).filter("part = 'term'").collect()
    for source in ("s0", "s1"):
        own = sorted((r["rank"], r["item"], r["value"]) for r in got if r["source"] == source)
        assert [r for r, _, _ in own] == list(range(1, 31))
        assert own == [(k + 1, i, v) for k, (v, i) in enumerate(sorted(((v, i) for _, i, v in own), key=lambda x: (-x[0], x[1])))]
    assert divergence.audit(docs(spark, [])).count() == 0

# ---- Ranked search


def _ranked(rows, items, top=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(words(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for place, (doc, c) in enumerate(counts):
            score = 0
            for w in words(text):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    m = 25 + (75 * sum(c.values()) * n) // total
                    score += weight * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, place))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc, _) in enumerate(sorted(scored)[:top])]
    return sorted(map(str, out))


def _search_case(seed):
    rng = random.Random(seed)
    words = [f"Word{i}" for i in range(40)] + ["über", "x-ray", "42"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "--"), (203, rows[0][1]), (203, rows[0][1]), (None, rows[1][1]), (204, "word1 " * 40_000)]
    items = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(20)]
    return rows, items + [("q0", items[0][1]), ("none", None), ("blank", ""), ("unseen", "nowhere"), (None, "word2 word2 über")]


@pytest.mark.parametrize("item_bytes", [1 << 22, 200])
def test_search_against_brute_force(spark, item_bytes):
    rows, items = _search_case(6)
    frame = spark.createDataFrame(items, "item_id string, text string")
    got = lexical.search(clashing(docs(spark, rows)), clashing(frame), item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == _ranked(rows, items)


def test_search_in_many_tiles_with_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOCS_TILE", 7)
    rows = [(i, "same words here") for i in range(60, 0, -1)] + [(100 + i, f"other{i} thing") for i in range(80)]
    items = [("a", "same words"), ("b", "words thing " * 5)]
    got = lexical.search(docs(spark, rows, 5), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == _ranked(rows, items)


def test_tiles_stay_exact():
    rng = np.random.default_rng(7)
    counts, weights = rng.integers(0, 50, (5, 30)), rng.integers(0, 40_000, 30)
    counts[2, 4] = 10**7
    exact = 2**45
    parts = lexical.tiles(counts, weights, width=8, exact=exact)
    back = np.zeros_like(counts)
    for columns, part in parts:
        assert len(columns) <= 8 and (part @ (weights[columns] * lexical.IMPACT)).max() < exact
        np.add.at(back.T, columns, part.T.astype(np.int64))
    assert (back == counts).all() and len(parts) > 4


def test_search_without_rows(spark):
    items = spark.createDataFrame([("a", "x")], "item_id string, text string")
    assert lexical.search(docs(spark, []), items).count() == 0
    assert lexical.search(docs(spark, [(1, None)]), items).count() == 0
    assert lexical.search(docs(spark, [(1, "x")]), items.limit(0)).count() == 0
