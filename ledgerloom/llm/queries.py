"""Queries over the driver's tables, one per corpus operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .hard_negatives import hard_negatives
from .html_extract import extract
from .license_scan import scan
from .near_dedup import near_duplicates
from .pii import personal_data
from .quality import quality
from .token_counts import histogram, token_lengths
from .toxicity import toxicity
from .unigram import encode
from .url_filter import LONG_SUFFIXES, judge, rule_outcomes
from .vector_codes import vector_codes

#: Vocabulary file that the encoding queries use; a parameter of the operators.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary splits texts before merging.
RANKS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The rules of the URL query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(token_lengths(table(spark, sf_dir, "documents"), RANKS, RANKS_PATTERN))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: what the rules say about the pages that they judge."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, rule_outcomes(pages, URL_RULES), URL_RULES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), PIECES)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id takes the next label first, as the query's contract has it."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("scanned")


QUERIES = {
    f.__name__: f
    for f in (op1_near_dedup, op2_decontaminate, op3_token_counts, op4_url_filter, op5_quality, op6_unigram, op7_html_text, op8_exact_dedup, op9_license_scan, op10_toxicity, op11_hard_negatives, op12_pii, op13_vector_codes)
}



def _lloyd_sql(rounds: int = 2) -> str:
    """Sixteen parts of four components, 64 entries: each round's nearest entries by the least of distance * 64 + index."""
    d = " + ".join(f"(x.v[{n}] - c.v[{n}]) ** 2" for n in range(1, 5))
    nearest = "a{r} AS (SELECT vec_id, label, x.p, any_value(x.v) AS v, min((" + d + ")::BIGINT * 64 + c.e) AS m FROM x JOIN c{r} c ON c.p = x.p GROUP BY vec_id, label, x.p)"
    mean = ", ".join(f"floor(sum(v[{n}]) / count(*))" for n in range(1, 5))
    update = "c{s} AS (SELECT p, e, coalesce(n.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT p, m % 64 AS e, [" + mean + "] AS v FROM a{r} GROUP BY ALL) n USING (p, e))"
    steps = ", ".join(f"{nearest.format(r=r)}, {update.format(r=r, s=r + 1)}" for r in range(rounds))
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS (SELECT vec_id, label, p, q[p * 4 + 1:p * 4 + 4] AS v FROM kept, range(16) t(p)),
        c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY e < 64),
        {steps}, {nearest.format(r=rounds)},
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label),
        book AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS sha FROM c{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded, book
    """


ORACLE_SQL = {
    "op1_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
        ), grams AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
        ), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, sides.b FROM reach JOIN sides ON sides.a = reach.r)
        SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, sets.doc_id = c AS kept
        FROM sets JOIN (SELECT v, min(r) AS c FROM reach GROUP BY v) ON v = sets.doc_id
    """,
    "op4_url_filter": rf"""
        WITH rest AS (
            SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
        ), p AS (
            SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
            FROM parts
        ), o AS (SELECT page_id, max(CASE WHEN rule IN ('org/', 'com/fr/') THEN 0 ELSE 1 END) AS bad FROM p WHERE rule IS NOT NULL GROUP BY 1),
        h AS (
            SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({", ".join(f"'{x}'" for x in LONG_SUFFIXES)}) THEN 2 ELSE 1 END AS labels,
                array_to_string(string_split(host, '.')[-labels - 1:], '.') AS domain, array_to_string(string_split(host, '.')[-labels:], '.') AS suffix
            FROM p LEFT JOIN o USING (page_id) GROUP BY host
        ), g AS (
            SELECT 'suffix' AS level, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix UNION ALL SELECT 'domain', sum(n), sum(k) FROM h GROUP BY domain UNION ALL SELECT 'host', n, k FROM h
        ), m AS (
            SELECT level, count(*) AS g, sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / n) AS kk, (sum(k) + 1) / (sum(n) + 2) AS rate FROM g WHERE n > 0 GROUP BY level
        ), s AS (SELECT *, (kk - k * k / n - (g - 1) * rate * (1 - rate)) / nullif(n - nn / n, 0) AS spread FROM m),
        prior AS (SELECT level, rate, CASE WHEN g > 1 AND spread > 0 THEN least(greatest(rate * (1 - rate) / spread - 1, 1), 1000) ELSE 1000 END AS m FROM s),
        sx AS (SELECT suffix, (sum(h.k) + any_value(m) * any_value(rate)) / (sum(h.n) + any_value(m)) AS r FROM h, prior WHERE level = 'suffix' GROUP BY suffix),
        dm AS (SELECT h.domain, (sum(h.k) + any_value(m) * any_value(sx.r)) / (sum(h.n) + any_value(m)) AS r FROM h JOIN sx USING (suffix), prior WHERE level = 'domain' GROUP BY h.domain),
        ab AS (SELECT host, n, h.k, h.k + m * dm.r AS a, n - h.k + m * (1 - dm.r) AS b FROM h JOIN dm USING (domain), prior WHERE level = 'host'),
        post AS (SELECT host, n, k, round(greatest(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0), 9) AS bound FROM ab)
        SELECT page_id, host, path, rule,
            CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
            n::BIGINT AS labelled, k::BIGINT AS bad, bound AS lower_bound
        FROM p JOIN post USING (host)
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_hard_negatives": """
        WITH k AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS a, a.label AS al, b.vec_id AS b, b.label AS bl, list_dot_product(a.q, b.q)::BIGINT AS s FROM k a JOIN k b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), pos AS (SELECT a, b AS p, s AS ps FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
        neg AS (
            SELECT s.a, p, ps, b, s, row_number() OVER (PARTITION BY s.a, p ORDER BY s DESC, b) AS r FROM pos JOIN s ON s.a = pos.a AND al <> bl AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps
        )
        SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM neg WHERE r <= 3
    """,
    "op13_vector_codes": _lloyd_sql(),
}
