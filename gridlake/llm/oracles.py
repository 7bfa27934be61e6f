"""DuckDB SQL of the vector queries: every vector against every entry, round by round."""

from __future__ import annotations

from . import centroids, vector_codes

_WHOLE = "embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)"
_FLOORS = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"
_AWAY = "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_FLOOR = "CAST((sum({x}) - ((sum({x}) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"  # of negative sums as well


def centroids_sql(clusters: int = centroids.CLUSTERS, size: int = centroids.DIMENSIONS, rounds: int = centroids.ROUNDS, seed: int = centroids.SEED) -> str:
    away = _AWAY.format(a="k.v", b="c.v")
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, {_FLOORS} AS v FROM embeddings WHERE {_WHOLE} AND len(embedding) = {size})",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v FROM (
            SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {clusters}))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT k.vec_id, k.v, min({{'distance': {away}, 'cluster': c.cluster}}) AS m
            FROM (SELECT row_number() OVER () AS i, * FROM kept) k, c{r} c GROUP BY k.i, k.vec_id, k.v)""")
        parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (
            SELECT cluster, list(x ORDER BY i) AS v FROM (
                SELECT m.cluster AS cluster, i, {_FLOOR.format(x="x")} AS x FROM (
                    SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY m.cluster, i)
            GROUP BY cluster) n ON n.cluster = c.cluster)""")
    return f"""WITH {", ".join(parts[:-1])}
        SELECT vec_id, m.cluster AS cluster, m.distance AS distance,
            CAST(sum(m.distance) OVER (PARTITION BY m.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(m.distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c ON c.cluster = m.cluster"""


def codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    away = _AWAY.format(a="k.x", b="b.x")
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS i, vec_id, label, v, len(v) // {parts} AS w FROM (
            SELECT vec_id, label, {_FLOORS} AS v FROM embeddings WHERE {_WHOLE} AND len(embedding) > 0 AND len(embedding) % {parts} = 0)
            QUALIFY len(v) = first_value(len(v)) OVER (ORDER BY vec_id NULLS LAST, v))""",
        f"cut AS MATERIALIZED (SELECT i, p, v[p * w + 1 : p * w + w] AS x FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, i AS e, x FROM cut WHERE i < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT k.i, k.p, any_value(k.x) AS x, min({{'distance': {away}, 'e': b.e}}) AS m
            FROM cut k JOIN b{r} b ON b.p = k.p GROUP BY k.i, k.p)""")
        steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (
            SELECT p, e, list(y ORDER BY j) AS x FROM (
                SELECT p, m.e AS e, j, {_FLOOR.format(x="y")} AS y FROM (SELECT p, m, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY p, m.e, j)
            GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)""")
    return f"""WITH {", ".join(steps[:-1])},
        told AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{rounds}),
        coded AS (SELECT i, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.distance) AS BIGINT) AS error FROM a{rounds} GROUP BY i)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, told.h AS codebooks_sha256
        FROM coded JOIN kept USING (i), told"""


CENTROIDS_SQL, CODES_SQL = centroids_sql(), codes_sql()
