"""Registered queries of the text operators and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelane.llm import (
    bpe, cross_polytope, digest_index, ext_sharding, hard_negatives, ngram_join, ordinal, packing, ranked_search, secret_scan, suffix_dedup,
    surrogates, wrappers,
)
from latelane.llm.common import read

#: Words of a packed training sequence.
SEQUENCE_WORDS = 2048
#: Bytes of a shard.
SHARD_BYTES = 1 << 20
#: Key of the surrogates; a deployment passes its own.
SURROGATE_KEY = b"replace this key"
#: Documents with less probability of the highest grade are rejected.
LEAST_TAIL = 0.5


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.redact(read(spark, sf_dir, "documents"), SURROGATE_KEY, count="n_entities")
    return found.select("doc_id", "text", "n_entities")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again, and digest both."""
    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(read(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded by a model fitted on the labels; ``kept`` is the pipeline's selection."""
    docs = read(spark, sf_dir, "documents")
    model = ordinal.train(docs, read(spark, sf_dir, "labels"), ordinal.grade_of_labels())
    return ordinal.score(docs, model).withColumn("kept", F.col("tail") >= LEAST_TAIL)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document matched with a digest index that is empty at first."""
    return digest_index.DigestIndex(spark).deduplicate(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), SEQUENCE_WORDS)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ext_sharding.assign(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its spans; the counts and the digest are of the patterns' spans alone."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.KINDS.index("random"))
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth vector; every seventh one counts under the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _matches_sql(kind: int, pattern: str, group: int = 0) -> str:
    """DuckDB SQL: each match of a pattern in ``t``, by the lengths of the pieces between the matches."""
    quoted = pattern.replace("'", "''")
    size = "list_sum(list_transform({}, lambda x: length(x)))"
    return f"""SELECT doc_id, {kind} AS kind, a, a + length(f[i]) AS b, f[i] AS m, v[i] AS v FROM (
        SELECT *, ({size.format('p[1:i]')} + coalesce({size.format('f[1:i - 1]')}, 0))::BIGINT AS a FROM (
            SELECT doc_id, p, f, v, unnest(range(1, len(f) + 1)) AS i FROM (
                SELECT doc_id, string_split_regex(text, '{quoted}') AS p, regexp_extract_all(text, '{quoted}', 0) AS f,
                       regexp_extract_all(text, '{quoted}', {group}) AS v FROM t)))"""


_S = secret_scan
_SECRETS_SQL = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    base AS (SELECT * FROM ({_matches_sql(0, _S.ASSIGN, 2)}) WHERE length(v) >= {_S.LEAST_VALUE}
             UNION ALL {_matches_sql(1, _S.ACCESS)} UNION ALL {_matches_sql(2, _S.HEX)}),
    runs AS (SELECT * FROM ({_matches_sql(3, _S.RUN)}) r WHERE regexp_matches(m, '[A-Za-z]')
             AND NOT EXISTS (SELECT 1 FROM base s WHERE s.doc_id = r.doc_id AND s.a < r.b AND s.b > r.a)),
    sample AS (SELECT text FROM t WHERE (SELECT count(*) FROM t) <= {_S.SAMPLE_DOCS}
               OR ('0x' || substr(md5(concat(doc_id, '|', text)), 1, 8))::BIGINT::DOUBLE * (SELECT count(*) FROM t) < 4294967296.0 * {_S.SAMPLE_DOCS}),
    words AS (SELECT w FROM (
        SELECT text, unnest(regexp_extract_all(regexp_replace(text, '{_S.ASSIGN.replace("'", "''")}', ' ', 'g'), '{_S.WORD}')) AS w FROM sample)
        GROUP BY w HAVING length(w) < {_S.LEAST_RANDOM} OR min(text) <> max(text)),
    tokens AS (SELECT DISTINCT v AS w, 1 AS r FROM base WHERE length(v) >= {_S.LEAST_RANDOM}
               UNION ALL SELECT w, 0 FROM words WHERE regexp_matches(w, '[A-Za-z]') AND NOT regexp_matches(w, '{_S.ACCESS}|{_S.HEX}')),
    pairs AS (SELECT r, CASE WHEN i = 1 THEN 0 ELSE ascii(substr(w, i - 1, 1)) END AS x, ascii(substr(w, i, 1)) AS y
              FROM (SELECT w, r, unnest(range(1, length(w) + 1)) AS i FROM tokens)),
    n AS (SELECT x, y, sum(r) AS nr, sum(1 - r) AS n0 FROM pairs GROUP BY 1, 2),
    l AS (SELECT x, sum(nr) AS lr, sum(n0) AS l0 FROM n GROUP BY 1),
    c AS (SELECT y, sum(nr) AS cr, sum(n0) AS c0 FROM n GROUP BY 1),
    w AS (SELECT coalesce(sum(nr), 0)::DOUBLE + {0.5 * _S.ALPHABET} AS wr, coalesce(sum(n0), 0)::DOUBLE + {0.5 * _S.ALPHABET} AS w0 FROM n),
    scored AS (
        SELECT doc_id, a, b, sum(floor(1000 * (
            ln((coalesce(nr, 0)::DOUBLE + {_S.DRAWN} * ((coalesce(cr, 0)::DOUBLE + 0.5) / wr)) / (coalesce(lr, 0)::DOUBLE + {_S.DRAWN}))
            - ln((coalesce(n0, 0)::DOUBLE + {_S.DRAWN} * ((coalesce(c0, 0)::DOUBLE + 0.5) / w0)) / (coalesce(l0, 0)::DOUBLE + {_S.DRAWN}))))) AS ratio
        FROM (SELECT doc_id, a, b, CASE WHEN i = 1 THEN 0 ELSE ascii(substr(m, i - 1, 1)) END AS x, ascii(substr(m, i, 1)) AS y
              FROM (SELECT *, unnest(range(1, length(m) + 1)) AS i FROM runs))
        LEFT JOIN l USING (x) LEFT JOIN c USING (y) LEFT JOIN n USING (x, y), w GROUP BY 1, 2, 3),
    spans AS (SELECT doc_id, a, kind, b FROM base UNION ALL SELECT doc_id, a, 3, b FROM scored WHERE ratio >= {_S.LEAST_RATIO}),
    named AS (SELECT doc_id, kind, a, concat({list(_S.KINDS)!r}[kind + 1], ':', a, ':', b) AS s FROM spans),
    g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(_S.KINDS))},
          string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans FROM named GROUP BY 1)
    SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _S.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN g USING (doc_id)
"""

_QUERIES = [
    op1_ngram_join, op2_pii, op3_bpe, op4_suffix_dedup, op5_html_extraction, op6_embedding_dedup, op7_quality_classifier,
    op8_exact_dedup, op9_best_fit_packing, op10_sharding, op11_secret_scans, op12_hard_negatives, op13_ranked_search,
]

_SQL = {
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS s FROM w
        ), classes AS (
            SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
        ), g AS (SELECT rep, n, unnest(s) AS x FROM classes),
        links AS (
            SELECT a.rep AS p, b.rep AS q FROM g a JOIN g b ON a.x = b.x AND a.rep <> b.rep
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach AS (SELECT rep AS p, rep AS q FROM classes UNION SELECT r.p, l.q FROM reach r JOIN links l ON l.p = r.q),
        comp AS (SELECT p AS rep, min(q) AS component_id FROM reach GROUP BY p)
        SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
        FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN comp USING (rep)
    """,
    "op4_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k
              FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM t WHERE n >= 100)),
        later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        marked AS (SELECT doc_id, i, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS fresh FROM later),
        grouped AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM grouped GROUP BY doc_id, g),
        cuts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last,
                 sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM cuts JOIN t USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(concat(head, substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id)
    """,
    "op5_html_extraction": r"""
        WITH a AS (
            SELECT page_id, url, string_split_regex(
                regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(h1|p)>') AS parts FROM pages
        ), b AS (
            SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(
                regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
                '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS t
            FROM a
        )
        SELECT page_id, url, array_to_string(t, chr(10)) AS text, length(array_to_string(t, chr(10))) AS n_chars FROM b
    """,
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ), r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
        c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY 1),
        n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)
    """,
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op10_sharding": f"""
        WITH t AS (
            SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
            FROM documents
        ), lv AS (SELECT doc_id, n_bytes, d, h >> (60 - d) AS prefix FROM t, (SELECT unnest(range(0, 61)) AS d)),
        s AS (SELECT d, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM lv GROUP BY 1, 2),
        fit AS (SELECT doc_id, n_bytes, d, prefix, shard_bytes, shard_docs FROM lv JOIN s USING (d, prefix)
                WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1)
        SELECT doc_id, n_bytes, right(lpad(prefix::BIT::VARCHAR, 64, '0'), d::INT) AS shard, d::INT AS depth,
               shard_bytes, shard_docs, shard_bytes > {SHARD_BYTES} AS oversized
        FROM fit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1
    """,
    "op11_secret_scans": _SECRETS_SQL,
    "op12_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT a, b AS p, score AS ps FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
        )
        SELECT a AS anchor_id, p AS positive_id, (row_number() OVER (PARTITION BY a, p ORDER BY score DESC, b))::INT AS rank,
               b AS negative_id, ps AS positive_score, score AS negative_score
        FROM p JOIN s USING (a) WHERE la <> lb AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps QUALIFY rank <= 10
    """,
    "op13_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
        ), q AS (
            SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark
        ), g AS (SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS words FROM d WHERE len(ws) > 0),
        tf AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
            WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3
        ), w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, docs),
        s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN tf USING (term), g GROUP BY 1, 2
        )
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
