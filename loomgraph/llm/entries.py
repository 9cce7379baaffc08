"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, collocations, decontam, host_text, langid, lz, orc_ids, packing, pii, set_join, spelling, token_counts, warc
from .common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = warc.write_arc(table(spark, sf_dir, "pages"), shared_path(spark, "arc"))
    records = warc.read_warc(warc.convert(arc, shared_path(spark, "warc")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents").withColumn("held_out", backoff_lm.held_out()))


def op3_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "orc")
    orc_ids.write_ids(table(spark, sf_dir, "documents"), path)
    return orc_ids.digest(orc_ids.read_ids(spark, path))


def op4_host_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_text.extract(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.digest(found).drop("longest")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.components(table(spark, sf_dir, "documents"))


def op8_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), model, "doc_id", "held_out")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted_words(table(spark, sf_dir, "documents")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_backoff_lm": op2_backoff_lm,
        "op3_orc_ids": op3_orc_ids,
        "op4_host_text": op4_host_text,
        "op5_decontamination": op5_decontamination,
        "op6_personal_data": op6_personal_data,
        "op7_set_join": op7_set_join,
        "op8_lz_fingerprints": op8_lz_fingerprints,
        "op9_language_id": op9_language_id,
        "op10_packing": op10_packing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_token_counts": op12_token_counts,
        "op13_collocations": op13_collocations,
    }


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

#: Lower-cases A-Z only, as the contract says; DuckDB's lower() would change other letters too.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w FROM benchmark),
     b2 AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM b2)),
     ks AS (SELECT DISTINCT k FROM win),
     dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, ks)),
     hit AS (SELECT r, i, dw.k AS k, item_id FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
     n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
     it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""


_SPACE_WORDS = r"list_filter(string_split_regex(" + _LOWER + r", '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SPACE_WORDS.format("text")}, []) AS w FROM documents),
     s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM d),
     e AS (SELECT r, len(g) AS n, unnest(g) AS h FROM s),
     pr AS (SELECT a.r AS ra, b.r AS rb, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.r <> b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
     l AS (SELECT ra, rb FROM pr WHERE 100 * c >= 90 * (na + nb - c)),
     reach AS (SELECT r AS root, r AS at FROM d UNION SELECT reach.root, l.rb FROM reach JOIN l ON reach.at = l.ra)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN reach ON s.r = reach.root JOIN d t ON t.r = reach.at GROUP BY s.r, s.doc_id, s.g
"""


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


_CRC_TABLE = "[" + ", ".join(str(_crc_entry(i)) for i in range(256)) + "]::UBIGINT[]"
#: Letters from U+00C0 on as single bytes, for DuckDB's edit distance, which counts bytes.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_BYTE_FOR = "".join(chr(c) for c in [*range(0x30, 0x61), *range(0x7B, 0x7F), *range(0x21, 0x30)] if chr(c) not in "'\\")[: len(_ACCENTED)]

OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS crcs),
     r0 AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
     r AS (SELECT d, {_LOWER.format("run")} AS run, count(*) AS k FROM r0 WHERE length(run) >= 7 GROUP BY ALL),
     b AS (SELECT run, k, list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(d || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [(192 + (unicode(c) >> 6))::UBIGINT, (128 + (unicode(c) & 63))::UBIGINT] END))) AS bytes FROM r),
     h AS (SELECT run, k, xor(list_reduce(bytes, lambda crc, x: xor(crc >> 8, crcs[CAST(xor(crc, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h FROM b, t),
     w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h),
     words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{_ACCENTED}', '{_BYTE_FOR}') AS flat FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
     cutw AS (SELECT word, n, flat, unnest(range(0, CAST(length(flat) + 1 AS BIGINT))) AS i FROM words),
     keyed AS (SELECT DISTINCT word, n, flat, CASE WHEN i = 0 THEN flat ELSE substr(flat, 1, i - 1) || substr(flat, i + 1) END AS x FROM cutw),
     pairs AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM keyed a JOIN keyed b ON a.x = b.x AND a.word <> b.word WHERE levenshtein(a.flat, b.flat) = 1),
     best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n, any_value(n) AS n FROM pairs GROUP BY word),
     form AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 10 * n),
     chain AS (SELECT word, word AS pos, 0 AS step FROM words UNION ALL SELECT chain.word, form.form, step + 1 FROM chain JOIN form ON form.word = chain.pos),
     root AS (SELECT word, first(pos ORDER BY step DESC) AS root FROM chain GROUP BY word)
SELECT word, n, coalesce(n_near, 0) AS n_near, form, form_n, root FROM words LEFT JOIN (SELECT word, n_near FROM best) USING (word) LEFT JOIN form USING (word) JOIN root USING (word)
"""

OP13_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r, unnest(string_split_regex({_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM p),
     g AS (SELECT lang, k, w[i:i + k - 1] AS path FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM w, range(1, 6) ks(k) WHERE len(w) >= k)),
     f AS (SELECT lang, k, array_to_string(path, ' ') AS phrase, any_value(path) AS path, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100 OR k = 1),
     tot AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS (SELECT * FROM f WHERE k >= 2 AND n >= 100),
     inner_ AS (SELECT lang, n, s, array_to_string(path[i:i + s - 1], ' ') AS phrase FROM (SELECT lang, n, path, k, s, unnest(range(1, CAST(k - s + 2 AS BIGINT))) AS i FROM c, range(2, 5) ss(s) WHERE s < k)),
     longer AS (SELECT lang, phrase, max(n) AS n FROM inner_ GROUP BY ALL),
     kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE longer.n IS NULL OR 100 * longer.n < 100 * c.n),
     cuts AS (SELECT lang, phrase, n AS a, j, array_to_string(path[1:j], ' ') AS x, array_to_string(path[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
     sc AS (SELECT c.lang, c.phrase, a, j, x.n AS l, y.n AS r, tot.n AS n, CAST((1000::HUGEINT * a * tot.n) // (x.n::HUGEINT * y.n) AS BIGINT) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y JOIN tot ON tot.lang = c.lang),
     least AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op5_decontamination": OP5_SQL, "op7_set_join": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op13_collocations": OP13_SQL}
