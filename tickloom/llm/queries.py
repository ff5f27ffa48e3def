"""The registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import byte_bpe, collocations, conversations, disclosure, embeddings, extraction, language_id, ordinal_quality, packing, piecewise, sharding, simhash, token_counts
from tickloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_pstable_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, by DuckDB's cosine, and their closure.
CHECKS["op2_pstable_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least.b AS component_id, vec_id = least.b AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""


@query
def op3_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", ordinal_quality.grade(F.col("toxic"), F.col("quality")).alias("grade"))


@query
def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.rate(table(spark, sf_dir, "documents"), ratings(spark, sf_dir))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


#: The given pages have one article each, of h1, p, b and br, and no references but these two in it.
CHECKS["op8_host_suffix_array"] = r"""
WITH parts AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS p FROM pages),
texts AS (SELECT page_id, url, array_to_string(list_filter(list_transform(p, lambda x:
    trim(regexp_replace(replace(replace(regexp_replace(x, '</?b>|<br>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM parts)
SELECT page_id, url, text, length(text) AS n_chars FROM texts"""


@query
def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.edit_resistance(table(spark, sf_dir, "documents"))


@query
def op11_interval_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.inspect(conversations.damage(given), given)


#: The check sum byte by byte, and the cheapest edits row by row over the states of the pattern.
CHECKS["op11_interval_parsing"] = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
dealt AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM given, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM dealt, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(c)),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT id, turn, role, text, left(role, 1) AS s, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, left(text, 32), md5(text)) AS i FROM damaged JOIN ids ON ids.conv_id IS NOT DISTINCT FROM damaged.conv_id),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(s) OVER (PARTITION BY id ORDER BY i) || s AS pair FROM numbered),
steps(s, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
inserts(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
edits AS (SELECT id, i, p, p AS q, 3 AS cost, 'D' AS edit FROM faults, unnest(range(4)) AS states(p)
    UNION ALL SELECT id, i, p, q, (fault = 'truncated')::INT, 'K' FROM faults JOIN steps USING (s) WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT id, i, p, q, 2 + (fault = 'truncated')::INT, 'R' FROM faults JOIN steps ON steps.s <> 's' WHERE fault NOT IN ('blank', 'duplicate')),
best(id, i, q, way) AS (SELECT id, 0::BIGINT, inserts.q, {'cost': inserts.cost, 'audit': inserts.audit} FROM ids, inserts WHERE inserts.p = 0
    UNION ALL SELECT b.id, e.i, n.q, min({'cost': b.way.cost + e.cost + n.cost, 'audit': b.way.audit || e.edit || n.audit})
    FROM best b JOIN edits e ON e.id = b.id AND e.i = b.i + 1 AND e.p = b.q JOIN inserts n ON n.p = e.q GROUP BY b.id, e.i, n.q),
ends AS (SELECT id, coalesce(max(i), 0) AS last FROM ids LEFT JOIN numbered USING (id) GROUP BY id),
found AS (SELECT b.id, min(way) AS way FROM best b JOIN ends ON ends.id = b.id AND ends.last = b.i WHERE b.q IN (0, 3) GROUP BY b.id),
marks AS (SELECT id, j, way.audit[j] AS edit, length(regexp_replace(way.audit[:j], 'I', '', 'g')) AS i FROM found, unnest(range(1, length(way.audit) + 1)) AS places(j)),
rows AS (SELECT m.id, m.j, m.edit, f.role, f.text, f.s, row_number() OVER (PARTITION BY m.id ORDER BY j) AS place FROM marks m LEFT JOIN faults f ON m.edit <> 'I' AND f.id = m.id AND f.i = m.i WHERE m.edit <> 'D'),
led AS (SELECT *, place - first_value(CASE WHEN edit = 'K' AND s = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY place) AS turn FROM rows),
texts AS (SELECT id, string_agg(CASE WHEN edit = 'K' THEN role WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS text FROM led GROUP BY id),
counts AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    way.cost::BIGINT AS cost, way.audit AS audit, sha256(coalesce(texts.text, '')) AS repaired_sha256
FROM ids JOIN found USING (id) LEFT JOIN texts USING (id) LEFT JOIN counts USING (id)"""


@query
def op12_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digests(disclosure.private_spans(table(spark, sf_dir, "documents")))


@query
def op13_partitioned_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: All phrases of up to five words counted at once; whole numbers of 128 bits.
CHECKS["op13_partitioned_phrases"] = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
grams AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k FROM starts, unnest(range(1, 6)) AS t(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, phrase, k, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
ordered AS (SELECT *, string_split(phrase, ' ') AS ws FROM f),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM ordered s JOIN ordered t ON s.lang = t.lang AND s.a = t.a AND s.k < t.k AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
cuts AS (SELECT o.lang, o.phrase, o.a, c, n, array_to_string(ws[:c], ' ') AS p, array_to_string(ws[c + 1:], ' ') AS q
    FROM ordered o JOIN sizes USING (lang), unnest(range(1, 5)) AS t(c) WHERE c < o.k AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = o.lang AND i.phrase = o.phrase)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, l.a AS l, r.a AS r, n, c, ((1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = p JOIN f r ON r.lang = cuts.lang AND r.phrase = q),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest QUALIFY rank <= 2000"""
