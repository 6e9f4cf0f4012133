"""Named queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import (chat, decontaminate, divergence, exact, html, language, lexical, lines, minhash, packing, repeats,
                         simhash, warc)
from netloom.llm.common import prepare, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Words of the contract as a class of DuckDB's engine: all but control, punctuation and spaces of ASCII.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1:s + k], ' ') AS g
       FROM (SELECT item_id, w, k, unnest(range(len(w) - k + 1)) AS s FROM bw)),
ks AS (SELECT DISTINCT k FROM bg),
dg AS (SELECT doc_id, k, s, array_to_string(w[s + 1:s + k], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, dg.k, item_id FROM dg JOIN bg USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_KEY = ("translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP3 = f"""
WITH l AS (SELECT doc_id, i, ls[i] AS line
           FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT doc_id, i, line, {_KEY} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT doc_id, i, line, keep IS NOT NULL AND keep <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

OP4 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op1_decontamination", OP1)
def _op1(spark, d):
    return decontaminate.contamination(read(spark, d, "documents"), read(spark, d, "benchmark")).drop("hit_words", "items")


@query("op3_line_dedup", OP3)
def _op3(spark, d):
    out = lines.drop_repeated(read(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_exact_dedup", OP4)
def _op4(spark, d):
    return exact.exact_dedup(read(spark, d, "documents"))


@query("op7_chat_formatting")
def _op7(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(added)))


@query("op10_packing")
def _op10(spark, d):
    return packing.pack(read(spark, d, "documents"))


@query("op5_language_id")
def _op5(spark, d):
    docs = read(spark, d, "documents")
    out = language.identify(docs, language.train(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op9_html_extraction")
def _op9(spark, d):
    return html.extract(read(spark, d, "pages"))

OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, b, unhex(sha1(b)) AS d, min(page_id) OVER (PARTITION BY b) AS f FROM p),
bits AS (SELECT page_id, CAST(d AS BIT)::VARCHAR AS x, octet_length(b) AS n, f FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST(substr(x, 1 + 5 * i, 5) AS BIT) AS BIGINT), 1)
                    FOR i IN range(32)], LAMBDA a, c: a || c) AS payload_digest,
       CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to
FROM bits
"""


@query("op2_warc", OP2)
def _op2(spark, d):
    return warc.round_trip(read(spark, d, "pages")).drop("url")


@query("op8_minhash")
def _op8(spark, d):
    return minhash.near_duplicates(read(spark, d, "documents"))


@query("op6_suffix_dedup")
def _op6(spark, d):
    return repeats.remove_repeats(read(spark, d, "documents")).drop("kept")


_TERMS12 = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS12} AS w
           FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p
      FROM f WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS q
      FROM l WINDOW w AS (PARTITION BY lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
       FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

_TERMS13 = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS13} AS w FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(w)) AS big_l FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n
      FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY r, doc_id, term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
       FROM t, s GROUP BY term),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS13} AS w FROM benchmark),
it AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY i, item_id, term),
v AS (SELECT i, item_id, r, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST(75 * n * big_n // big_l AS BIGINT))))) AS BIGINT) AS score
      FROM it JOIN wt USING (term) JOIN t USING (term), s GROUP BY i, item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
      FROM v WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


@query("op11_simhash")
def _op11(spark, d):
    return simhash.near_duplicates(read(spark, d, "documents"))


@query("op12_source_divergence", OP12)
def _op12(spark, d):
    return divergence.audit(read(spark, d, "documents"))


@query("op13_lexical_search", OP13)
def _op13(spark, d):
    return lexical.search(read(spark, d, "documents"), read(spark, d, "benchmark"))
