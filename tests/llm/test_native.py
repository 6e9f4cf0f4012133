import hashlib
import re
from collections import defaultdict

import pytest
from helpers import by_id, clashing, docs
from pyspark.sql import functions as F

from netloom.llm import decontaminate, exact, lines

PASSAGE = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omikron"
TEXTS = [(1, "a b"), (2, "a b"), (9, "a b"), (3, None), (4, ""), (5, "A b"), (6, "a b "), (9, "a b"), (None, "a b"),
         (7, "x " * 40_000), (8, "x " * 40_000)]


def test_exact_groups_and_odd_rows(spark):
    got = exact.exact_dedup(clashing(docs(spark, TEXTS))).collect()
    assert len(got) == len(TEXTS)
    seen = defaultdict(set)
    for r in got:
        seen[r.doc_id].add((r.keep_id, r.group_size, r.kept))
    assert seen == {1: {(9, 5, False)}, 2: {(9, 5, False)}, 9: {(9, 5, True)}, None: {(9, 5, False)},
                    3: {(4, 2, False)}, 4: {(4, 2, True)}, 5: {(5, 1, True)}, 6: {(6, 1, True)},
                    7: {(8, 2, False)}, 8: {(8, 2, True)}}
    assert by_id(exact.exact_dedup(docs(spark, TEXTS)))[3].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_exact_compares_texts_not_digests(spark):
    weak = F.substring(F.unhex(F.sha2("text", 256)), 1, 0)
    got = by_id(exact.exact_dedup(docs(spark, TEXTS), digest=weak))
    want = by_id(exact.exact_dedup(docs(spark, TEXTS)))
    assert got == want


def test_exact_keep_passes_columns(spark):
    df = clashing(docs(spark, TEXTS))
    out = exact.keep(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [4, 5, 6, 8, 9]


@pytest.mark.parametrize("fn", [lambda d: exact.exact_dedup(d), lambda d: exact.keep(d), lambda d: lines.drop_repeated(d)])
def test_empty_tables(spark, fn):
    assert fn(docs(spark, [(1, "x")]).limit(0)).collect() == []


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _contaminated(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = _words(text)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s:s + k])].add(str(item))
    out = {}
    for doc, text in rows:
        w, hit, found = _words(text), set(), set()
        for k in range(1, 14):
            for s in range(len(w) - k + 1):
                own = windows.get(tuple(w[s:s + k]))
                if own:
                    hit |= set(range(s, s + k))
                    found |= own
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination_matches_brute_force(spark, limit):
    rows = [(1, PASSAGE), (2, f"{'w ' * 400}{PASSAGE.upper()}!"), (3, None), (4, ""), (5, "?!"), (6, "Été été short one"),
            (7, PASSAGE.replace("nu", "NU,") + " " + PASSAGE), (8, "short  -- one twice short.one"),
            (9, "f " * 30), (10, "x" * 60_000)]
    items = [(1, PASSAGE), (2, "short one"), (10, "one"), (3, None), (4, "..."), (11, PASSAGE), (12, "ÉTÉ"),
             (5, "f " * 14)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("gram", F.lit(1))
    got = decontaminate.contamination(clashing(docs(spark, rows)), bench, broadcast_bytes=limit)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == \
        _contaminated(rows, items)
    left = decontaminate.drop_documents(clashing(docs(spark, rows)), bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 10]


def test_decontamination_drops_rows_not_ids(spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    rows = [(None, PASSAGE), (None, "clean"), (None, None), (3, PASSAGE), (3, "clean too"), (4, PASSAGE + " end")]
    left = decontaminate.drop_documents(clashing(docs(spark, rows)), bench)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(None, "clean"), (None, None), (3, "clean too")], key=str)


def test_decontamination_empty_and_cut(spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    rows = [(1, f"Keep, this. {PASSAGE}; and that!\n"), (2, "clean text"), (3, None), (4, PASSAGE)]
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(docs(spark, rows), bench).collect()}
    assert cut == {1: "Keep, this; and that!\n", 2: "clean text", 3: None, 4: ""}
    none = decontaminate.contamination(docs(spark, rows), bench.limit(0)).collect()
    assert len(none) == 4 and not any(r.contaminated for r in none)
    assert decontaminate.contamination(docs(spark, rows).limit(0), bench).collect() == []


def _dropped(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    holders = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(doc)
    out = {}
    for doc, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not (len(holders[key(x)]) >= 3 and max(holders[key(x)]) != doc)]
        out[doc] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


def test_lines_match_brute_force(spark):
    line, other = "This line is repeated often É", "another line of sufficient length"
    rows = [(i, f"{line}\nown {i}\n {line.replace('T', 't')}\t\n{other if i < 2 else ''}") for i in range(6)]
    rows += [(10, None), (11, ""), (12, "\n\n"), (13, line + "\r\n" + "z" * 30_000), (14, "É" * 19), (15, other.upper())]
    rows += [(20 + i, "short line") for i in range(4)] + [(30, f"{line} ")]
    for batches, parts in ((4, 3), (9, 1)):
        got = lines.drop_repeated(clashing(docs(spark, rows, parts)), batches=batches)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == _dropped(rows)


def test_lines_levels_and_unseen(spark):
    runs = lines.LineRuns(spark, fanout=2)
    batches = [docs(spark, [(10 * b + i, f"line number {i % (b + 1)} of a corpus") for i in range(4)]) for b in range(5)]
    fresh = []
    for batch in batches:
        own = lines.line_rows(batch).select("digest", "row", "doc_id").distinct()
        fresh.append(runs.unseen(own).select("digest").distinct().count())
        runs.add(own)
    assert fresh == [1, 1, 1, 1, 0]
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.n_docs, r.keep_doc) for r in runs.totals().collect()} == {(10, 40), (5, 41), (3, 42), (2, 43)}


def test_lines_are_in_one_run(spark):
    """Known lines update, unknown ones enter: no digest is in two runs, and all batches are counted."""
    runs = lines.LineRuns(spark, fanout=3)
    for b in range(5):
        rows = [(10 * b + i, f"line number {i * (b + 1) % 7} of a corpus\nline of batch {b} alone, row {i}") for i in range(6)]
        runs.add(lines.line_rows(docs(spark, rows)).select("digest", "row", "doc_id").distinct())
    held = runs._read(runs._runs(), known=False)
    assert held.count() == held.select("digest").distinct().count() == 7 + 30
    assert runs._read(runs.updates, known=True).count() > 0
    assert sorted(r.n_docs for r in runs.totals().collect())[:30] == [1] * 30
    assert runs.totals().selectExpr("sum(n_docs)").first()[0] == 60
