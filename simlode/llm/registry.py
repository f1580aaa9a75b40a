"""Queries of this subpackage, by problem, and the SQL of those that SQL can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlode.llm import clusters, leaks, membership, neighbours, subjects, tokens
from simlode.session import settle, spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in a cluster, with the cluster's first request."""
    members = clusters.clustered(table(spark, sf_dir, "insert_requests"))
    return members.where("member_no <> first_no").select("first_no", "member_no")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and most typical requests."""
    return clusters.described(clusters.clustered(table(spark, sf_dir, "insert_requests")))


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters and described members by size of the cluster."""
    return p1_clusters(spark, sf_dir).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"), F.sum(F.size("typical")).alias("typical"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose id is stored or came in an earlier request."""
    requests, stored = table(spark, sf_dir, "insert_requests"), table(spark, sf_dir, "stored_ids")
    flagged = settle(membership.seen_before(requests, stored, "request_no", "id"), "p4")
    checked = membership.confirmed(requests, stored, flagged, "request_no", "id")
    return checked.where("right").selectExpr("n AS request_no")


def p4_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the tables' answers are wrong."""
    requests, stored = table(spark, sf_dir, "insert_requests"), table(spark, sf_dir, "stored_ids")
    flagged = settle(membership.seen_before(requests, stored, "request_no", "id"), "p4")
    return membership.audit(requests, "id", flagged, membership.confirmed(requests, stored, flagged, "request_no", "id"))


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records asked, those rightly taken for seen, and whether fewer than one in 500 are wrongly so."""
    return p4_audit(spark, sf_dir).selectExpr("asked", "flagged - wrong AS right", "wrong_rate < 0.002 AS rarely_wrong")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar stored vectors of each search request."""
    return neighbours.most_similar(table(spark, sf_dir, "insert_requests"), table(spark, sf_dir, "search_requests")).select("query_id", "request_no")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a part of an evaluation item, with the item."""
    return leaks.leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def p7_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an evaluation item with other values in its slots, with the item."""
    return leaks.reparameterised(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each of their subject areas."""
    return subjects.subject_areas(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of the corpus: documents by subject area."""
    return p8_found(spark, sf_dir).groupBy("subject").count()


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p1_sizes": p1_sizes, "p4_found": p4_found, "p4_audit": p4_audit, "p4_bounds": p4_bounds, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_reparameterised": p7_reparameterised, "p8_found": p8_found, "p8_mix": p8_mix}

# Vectors that count, as unit vectors; the filter comes before the norm, which must not meet a wrong size.
_SOUND = """
    WITH f AS (SELECT request_no, vector::DOUBLE[] AS v FROM insert_requests
               WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    u AS (SELECT request_no, v FROM f WHERE list_dot_product(v, v) > 0)
"""

_CLUSTERS = _SOUND + """
        , p AS (SELECT a.request_no AS x, b.request_no AS y FROM u a JOIN u b ON list_cosine_similarity(a.v, b.v) >= 0.85 OR a.request_no = b.request_no),
        n AS (SELECT x, list(y ORDER BY y) AS ys FROM p GROUP BY x HAVING count(*) >= 5),
        c AS (SELECT ys FROM n GROUP BY ys HAVING count(*) = len(ys))
"""

SQL = {
    "p1_found": _CLUSTERS + " SELECT ys[1] AS first_no, x AS member_no FROM n JOIN c USING (ys) WHERE x <> ys[1]",
    "p1_sizes": _CLUSTERS + " SELECT len(ys) AS size, count(*) AS clusters, 3 * count(*) AS typical FROM c GROUP BY len(ys)",
    "p4_found": """
        WITH f AS (SELECT id, min(request_no) AS first FROM insert_requests GROUP BY id)
        SELECT r.request_no FROM insert_requests r JOIN f USING (id)
        WHERE r.id <> '' AND (f.first < r.request_no OR r.id IN (SELECT id FROM stored_ids WHERE id IS NOT NULL))
    """,
    "p4_bounds": """
        WITH f AS (SELECT id, min(request_no) AS first FROM insert_requests GROUP BY id)
        SELECT count(*) AS asked, count(*) FILTER (f.first < r.request_no OR r.id IN (SELECT id FROM stored_ids WHERE id IS NOT NULL)) AS "right", TRUE AS rarely_wrong
        FROM insert_requests r JOIN f USING (id) WHERE r.id <> ''
    """,
    "p5_found": _SOUND + """
        , q AS (SELECT query_id, min(coalesce(top_k, 5)) AS k, min(vector::DOUBLE[]) AS w FROM search_requests
                WHERE coalesce(top_k, 5) >= 1 AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY query_id),
        c AS (SELECT query_id, k, request_no, list_cosine_similarity(v, w) AS cosine FROM q, u WHERE list_dot_product(w, w) > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, request_no) AS place FROM c)
        SELECT query_id, request_no FROM r WHERE place <= k AND cosine >= 0.85
    """,
}
