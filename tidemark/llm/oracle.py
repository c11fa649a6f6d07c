"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import cluster

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY sha1(html), strlen(html)) END AS latest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN latest <> page_id THEN latest END AS refers_to
FROM d"""


def clusters(k: int = cluster.CLUSTERS, rounds: int = cluster.ROUNDS, dimensions: int = cluster.DIMENSIONS, scale: int = cluster.SCALE, seed: int = cluster.SEED) -> str:
    """Rounds written one after the other; every vector is held against every centroid, number by number."""
    parts = [
        f"""v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
          WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dimensions})""",
        "n AS (SELECT vec_id, generate_subscripts(ints, 1) AS place, unnest(ints) AS x FROM v)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id))) - 1 AS cluster FROM v ORDER BY 2 LIMIT {k})",
        "c0 AS (SELECT f.cluster, n.place, n.x FROM f JOIN n USING (vec_id))",
    ]
    for i in range(rounds + 1):
        parts += [
            f"d{i} AS (SELECT n.vec_id, c.cluster, CAST(sum((n.x - c.x) * (n.x - c.x)) AS BIGINT) AS distance FROM n JOIN c{i} AS c USING (place) GROUP BY n.vec_id, c.cluster)",
            f"a{i} AS (SELECT vec_id, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)",
        ]
        if i < rounds:
            parts += [
                f"m{i} AS (SELECT a.cluster, n.place, CAST(sum(n.x) AS BIGINT) AS s, count(*) AS q FROM a{i} AS a JOIN n USING (vec_id) GROUP BY a.cluster, n.place)",
                f"""c{i + 1} AS (SELECT c.cluster, c.place, CASE WHEN m.q IS NULL THEN c.x ELSE (m.s - (m.s % m.q + m.q) % m.q) // m.q END AS x
                  FROM c{i} AS c LEFT JOIN m{i} AS m ON m.cluster = c.cluster AND m.place = c.place)""",
            ]
    parts.append(f"h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return f"""WITH {", ".join(parts)}
    SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
    FROM a{rounds} AS a JOIN h ON h.cluster = a.cluster"""
