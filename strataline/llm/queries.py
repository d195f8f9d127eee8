"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS o FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
s1 AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
            - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
        / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lev FROM s1),
s3 AS (SELECT arg_min(lev, CAST(cap AS DOUBLE) / w) AS lev FROM s2 WHERE cap > w * lev),
s AS (SELECT source, source_size, w, coalesce(least(CAST(cap AS DOUBLE), w * (SELECT lev FROM s3)), CAST(cap AS DOUBLE)) AS target FROM s2),
r AS (SELECT d.doc_id, size, source_size, w, target, CAST(floor(target) AS BIGINT) AS t, CAST(coalesce(sum(size) OVER (
        PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, greatest(0, least(size, t - b)) + greatest(0, least(size, t - b - source_size)) AS taken FROM r
"""


@query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark, sf):
    from strataline.llm import mixing
    from strataline.llm.common import settle

    # texts are read once: the queue itself only carries sizes and shuffle keys
    rows = settle(mixing.queue_rows(documents(spark, sf), []))
    return mixing.schedule(rows).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target",
        F.aggregate("sent", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"))


@query("op6_hilbert_shards")
def op6_hilbert_shards(spark, sf):
    from strataline.llm import sharding

    return sharding.shard_documents(documents(spark, sf))


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
        string_split(regexp_replace(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)) AS n FROM d),
g AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
gw AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM gw WHERE k > 1) GROUP BY r),
ln AS (SELECT r, source, text, x, len(string_split(x, ' ')) AS words FROM (SELECT r, source, text, trim(unnest(n)) AS x FROM t) WHERE x <> ''),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
freq AS (SELECT f.source, x FROM (SELECT source, x, count(DISTINCT text) AS k FROM ln GROUP BY source, x) f
         JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE k > 20 AND k > 0.03::DOUBLE * docs),
lost AS (SELECT r, sum(words) AS lost FROM ln JOIN freq ON ln.source IS NOT DISTINCT FROM freq.source AND ln.x = freq.x GROUP BY r),
b AS (SELECT t.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        coalesce(lost, 0) AS lost FROM t LEFT JOIN cov ON t.r = cov.r LEFT JOIN lost ON t.r = lost.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (2 * lost > n_words) AS kept FROM b
"""


@query("op7_line_frequency", QUALITY_SQL)
def op7_line_frequency(spark, sf):
    from strataline.llm import quality
    from strataline.llm.common import settle

    features = settle(quality.text_features(documents(spark, sf), ["doc_id"]))
    return quality.verdicts(features).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_token_lengths")
def op8_token_lengths(spark, sf):
    from strataline.llm import lengths

    return lengths.suffix_sums(lengths.histogram(documents(spark, sf)))


def _canonical_sql(text: str) -> str:
    from strataline.llm.licences import SPELLINGS

    c = f"regexp_replace(regexp_replace(lower({text}), '(?m)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*$', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for other, one in SPELLINGS:
        c = f"replace({c}, '{other}', '{one}')"
    return c


def _licence_sql() -> str:
    from strataline.llm.licences import KNOWN

    known = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in KNOWN)

    def whole(c):
        return f"nullif(trim(regexp_replace({c}, '[ \\n]+', ' ', 'g')), '')"
    return f"""
    WITH k AS (SELECT md5({whole(_canonical_sql('text'))}) AS digest, min(name) AS licence FROM (VALUES {known}) v(name, text) GROUP BY 1),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_canonical_sql('text')} AS c FROM documents),
    w AS (SELECT r, doc_id, c, md5({whole('c')}) AS digest FROM d),
    n AS (SELECT r, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT licence)), ',') AS notices
          FROM (SELECT r, md5(trim(unnest(string_split(c, chr(10))))) AS digest FROM d) x JOIN k USING (digest) GROUP BY r)
    SELECT doc_id, w.digest, licence, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
    FROM w LEFT JOIN k ON w.digest = k.digest LEFT JOIN n ON w.r = n.r"""


@query("op9_licence_digests", _licence_sql())
def op9_licence_digests(spark, sf):
    from strataline.llm import licences

    return licences.scan(documents(spark, sf), licences.known_table(spark))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf):
    from strataline.llm import substrings

    return substrings.report(documents(spark, sf))


@query("op4_minhash_groups")
def op4_minhash_groups(spark, sf):
    from strataline.llm import minhash

    return minhash.groups(documents(spark, sf)).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


@query("op5_toxic_segments")
def op5_toxic_segments(spark, sf):
    from strataline.llm import toxicity

    return toxicity.score_documents(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op10_sentence_pieces")
def op10_sentence_pieces(spark, sf):
    from strataline.llm import pieces

    return pieces.report(documents(spark, sf))


@query("op2_image_copies")
def op2_image_copies(spark, sf):
    """Every vector as a picture; an edited copy of each picture whose id is divisible by 20 is looked up among all."""
    from strataline.llm import media

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("cast(vec_id as long) as vec_id", "embedding")
    return media.find_copies(vectors.where("vec_id % 20 = 0"), vectors, media.drawn_and_edited, media.drawn)


MERKLE_SQL = r"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
        coalesce(strlen(text) || ':' || text, '-') AS z,
        coalesce(xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
            lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
            lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1)))) % 7 = 0, false) AS bad FROM documents),
l AS (SELECT r, doc_id, coalesce('=' || lang, '-') AS t, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
        sha256(a || coalesce(strlen(CAST(n_chars + CAST(bad AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(bad AS INT)), '-') || z) AS start FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM l),
lv AS (SELECT t, 0 AS level, pos, n, leaf AS h FROM p UNION ALL
    SELECT t, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY t, level, pos // 2, n),
s AS (SELECT t, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (SELECT 0 AS level, pos, n, subroot AS h FROM s UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tv WHERE n > 1 GROUP BY level, pos // 2, n),
c AS (SELECT r, t, 0 AS level, pos, n, start AS h, '' AS proof FROM p UNION ALL
    SELECT c.r, c.t, c.level + 1, c.pos // 2, (c.n + 1) // 2,
        sha256(CASE WHEN c.pos % 2 = 1 THEN lv.h || c.h ELSE c.h || coalesce(lv.h, '') END), c.proof || coalesce(lv.h, '')
    FROM c LEFT JOIN lv ON lv.t = c.t AND lv.level = c.level AND lv.pos = xor(c.pos, 1) WHERE c.n > 1),
u AS (SELECT c.r, 0 AS level, s.pos, s.n, c.h, c.proof, s.subroot FROM c JOIN s ON c.t = s.t WHERE c.n = 1 UNION ALL
    SELECT u.r, u.level + 1, u.pos // 2, (u.n + 1) // 2,
        sha256(CASE WHEN u.pos % 2 = 1 THEN tv.h || u.h ELSE u.h || coalesce(tv.h, '') END), u.proof || coalesce(tv.h, ''), u.subroot
    FROM u LEFT JOIN tv ON tv.level = u.level AND tv.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT p.doc_id, p.leaf, u.subroot, tv.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = tv.h AS verified
FROM u JOIN p ON u.r = p.r JOIN tv ON tv.n = 1 WHERE u.n = 1
"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark, sf):
    from strataline.llm import merkle

    return merkle.report(documents(spark, sf))


WINDOW_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, i FROM g JOIN low USING (g) WHERE coalesce(doc_id > low, low IS NOT NULL)),
gone AS (SELECT r, list(DISTINCT p) AS p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM hit) GROUP BY r),
x AS (SELECT d.r, doc_id, w, coalesce(p, []) AS p FROM d LEFT JOIN gone ON d.r = gone.r),
kept AS (SELECT r, string_agg(w[i], ' ' ORDER BY i) AS t FROM (SELECT r, w, p, unnest(range(1, len(w) + 1)) AS i FROM x) WHERE NOT list_contains(p, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM x LEFT JOIN kept ON x.r = kept.r
"""


@query("op12_window_dedup", WINDOW_SQL)
def op12_window_dedup(spark, sf):
    from strataline.llm import windows

    return windows.report(documents(spark, sf))


SEARCH_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS x FROM documents),
d AS (SELECT r, doc_id, CAST(len(x) AS BIGINT) AS n FROM t WHERE len(x) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(x) AS term FROM t) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, c),
q AS (SELECT k, item_id, term, count(*) AS m FROM (SELECT row_number() OVER () AS k, item_id,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY ALL),
s AS (SELECT k, item_id, d.r, doc_id, CAST(sum(q.m * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // l))))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d ON d.r = tf.r, c GROUP BY k, item_id, d.r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM
    (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13_lexical_search(spark, sf):
    from strataline.llm import lexical

    return lexical.search(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
