"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, license_scan, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_counts, toxicity, warc
from millrace.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_digests(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: the neighbours of one source and language share a directory, and any
    that holds a notice states its licence."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 200).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(docs.withColumn("path", path), stating="any")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_rules, op2_toxicity, op3_simhash_dedup, op4_decontaminate, op5_substring_dedup, op6_license_scan, op7_packing,
    op8_suffix_dedup, op9_warc, op10_token_counts,
)
QUERIES = {f.__name__: f for f in _ALL}

def _notices() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(name)}, {k}, {quote(n)})" for name, several in license_scan.TEMPLATES.items() for k, n in enumerate(several))


#: DuckDB SQL for the rows of queries; the tests hold the others against brute force.
ORACLE_SQL = {
    "op4_decontaminate": r"""
        WITH b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') AS w FROM benchmark
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') AS w FROM documents
        ), items AS (
            SELECT item_id, len(w) AS n, least(5, len(w)) AS k, w FROM b WHERE len(w) > 0
        ), wanted AS (
            SELECT item_id, n, k, array_to_string(w[i : i + k - 1], ' ') AS s, count(*) AS c FROM items, unnest(range(1, n - k + 2)) AS t(i) GROUP BY ALL
        ), placed AS (
            SELECT doc_id, len(w) AS m, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
            FROM d, (SELECT DISTINCT k FROM items) AS sizes, unnest(range(1, len(w) - k + 2)) AS t(i)
        ), starts AS (
            SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(1, i - (n - k)), least(i, m - n + 1) + 1)) AS a FROM placed JOIN wanted USING (k, s)
        ), met AS (
            SELECT x.doc_id, x.item_id, x.n, x.k, x.a, p.s, count(*) AS c FROM starts AS x
            JOIN placed AS p ON p.doc_id = x.doc_id AND p.k = x.k AND p.i BETWEEN x.a AND x.a + x.n - x.k GROUP BY ALL
        ), scored AS (
            SELECT doc_id, item_id, n, a, CAST(sum(CASE WHEN wanted.c IS NULL THEN 0 ELSE least(met.c, wanted.c) END) AS BIGINT) AS shared, 2 * (n - k + 1) AS total
            FROM met LEFT JOIN wanted USING (item_id, n, k, s) GROUP BY doc_id, item_id, n, k, a
        ), best AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared DESC, a) AS nth FROM scored
        )
        SELECT doc_id, item_id, shared / (total - shared) AS similarity, a - 1 AS first_word, n AS n_words FROM best WHERE nth = 1 AND shared >= 0.8 * (total - shared)
    """,
    "op5_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(i)
        ), twice AS (
            SELECT s FROM windows GROUP BY s HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN twice USING (s)
        ), kept AS (
            SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS text, count(*) AS n
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) AS x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op6_license_scan": r"""
        WITH f AS (
            SELECT doc_id, source || '/' || lang || '/' || (doc_id // 200) || '/' || doc_id || '.txt' AS path, source || '/' || lang || '/' || (doc_id // 200) AS folder,
                coalesce(text, '') AS text FROM documents
        ), notices(license, notice, text) AS (
            VALUES NOTICES
        ), known AS (
            SELECT license, notice, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}-]+'), lambda x: x <> '')) AS term FROM notices
        ), seen AS (
            SELECT term, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}-]+')) AS term FROM f) AS x GROUP BY term
        ), size AS (
            SELECT count(*) AS n FROM f
        ), idf AS (
            SELECT term, ln((n + 1) / (coalesce(c, 0) + 1)) + 1 AS weight FROM (SELECT term FROM known UNION SELECT term FROM seen) AS v CROSS JOIN size LEFT JOIN seen USING (term)
        ), own AS (
            SELECT license, notice, term, count(*) * any_value(weight) AS w FROM known JOIN idf USING (term) GROUP BY license, notice, term
        ), units AS (
            SELECT license, notice, term, w / sqrt(sum(w * w) OVER (PARTITION BY license, notice)) AS unit FROM own
        ), lines AS (
            SELECT doc_id, string_split(text, chr(10)) AS l FROM f
        ), runs AS (
            SELECT doc_id, k, span, array_to_string(l[k : k + span - 1], chr(10)) AS run FROM lines, unnest(range(1, 5)) AS s(span), unnest(range(1, len(l) - span + 2)) AS t(k)
        ), terms AS (
            SELECT doc_id, k, span, unnest(list_filter(regexp_split_to_array(lower(run), '[^\p{L}\p{N}-]+'), lambda x: x <> '')) AS term FROM runs
        ), counted AS (
            SELECT doc_id, k, span, term, count(*) * any_value(weight) AS w FROM terms JOIN idf USING (term) GROUP BY doc_id, k, span, term
        ), norms AS (
            SELECT doc_id, k, span, sqrt(sum(w * w)) AS norm FROM counted GROUP BY doc_id, k, span
        ), dots AS (
            SELECT doc_id, k, span, license, notice, sum(w * unit) AS dot FROM counted JOIN units USING (term) GROUP BY doc_id, k, span, license, notice
        ), best AS (
            SELECT doc_id, license, similarity FROM (
                SELECT doc_id, license, round(dot / norm, 6) AS similarity, row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / norm, 6) DESC, license) AS nth
                FROM dots JOIN norms USING (doc_id, k, span)
            ) AS x WHERE nth = 1 AND similarity >= 0.6
        ), states AS (
            SELECT folder, first(license ORDER BY similarity DESC, license) AS inherited FROM f JOIN best USING (doc_id) GROUP BY folder
        ), near AS (
            SELECT x.folder, first(s.inherited ORDER BY length(s.folder) DESC) AS inherited, first(s.folder ORDER BY length(s.folder) DESC) AS ancestor
            FROM (SELECT DISTINCT folder FROM f) AS x JOIN states AS s ON x.folder = s.folder OR starts_with(x.folder, s.folder || '/') GROUP BY x.folder
        )
        SELECT doc_id, path, coalesce(license, inherited) AS license, similarity,
            CASE WHEN license IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' END AS origin,
            CASE WHEN license IS NULL THEN ancestor END AS inherited_from
        FROM f LEFT JOIN best USING (doc_id) LEFT JOIN near USING (folder)
    """.replace("NOTICES", _notices()),
    "op8_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), windows AS (
            SELECT doc_id, i, array_slice(b, i, i + 99) AS s FROM d, unnest(range(1, n - 98)) AS t(i)
        ), later AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM windows) AS x WHERE nth > 1
        ), marked AS (
            SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS begins FROM later
        ), numbered AS (
            SELECT doc_id, i, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
        ), runs AS (
            SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY doc_id, run
        ), pieces AS (
            SELECT doc_id, coalesce(lag(z) OVER w, 1) AS a, runs.a AS z FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY runs.a)
            UNION ALL SELECT doc_id, max(runs.z), max(n) + 1 FROM runs JOIN d USING (doc_id) GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, string_agg(substr(hex(b), CAST(2 * a - 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '' ORDER BY a) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
        ), removed AS (
            SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS bytes, count(*) AS spans FROM runs GROUP BY doc_id
        )
        SELECT doc_id, n AS n_bytes, coalesce(bytes, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256
        FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), q AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS best FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN best <> page_id THEN best END AS refers_to
        FROM q
    """,
}
