"""Encoding, similarity scores, centroids, neighbours and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.checks.registry import Tables, check, rounded, sql_key, sql_vectors, with_views
from palimpsest.functions import vectors as vx
from palimpsest.operators import clusters, density, generate, neighbours, scoring
from palimpsest.session import cut_lineage

_PROMPTS = ("prompts", sql_vectors("pv", "SELECT prompt_id AS id, rewrite_prompt AS text FROM prompts"))
_BENCH = sql_vectors("bv", "SELECT item_id AS id, text FROM benchmark")
_UNITS = """units AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
_CENTRES = """cells AS (SELECT label, i, avg(v[i]) AS x FROM units, range(1, 65) r(i) GROUP BY label, i),
centres AS (SELECT label, list(x ORDER BY i) AS c FROM cells GROUP BY label)"""


def _label_centres(t: Tables):
    return scoring.centroid(t.embeddings, "embedding", ("label",))


@check("encode_text", with_views("SELECT id, i - 1 AS i, round(v[i], 9) AS x FROM bv, range(1, 17) r(i)", _BENCH))
def _(t: Tables):
    cells = t.benchmark_vectors.select("id", F.posexplode("vector").alias("i", "x"))
    return cells.select("id", F.col("i").cast("long").alias("i"), rounded("x", 9).alias("x"))


@check(
    "encode_with_model",
    """SELECT item_id, len(text)::DOUBLE AS chars, (len(text) - len(replace(text, 'e', '')))::DOUBLE AS es FROM benchmark""",
)
def _(t: Tables):
    def load():
        return lambda batch: [(len(x), x.count("e")) for x in batch]

    encoded = generate.encode_with(t.benchmark, "text", load)
    return encoded.select("item_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("es"))


@check(
    "join_known_vectors",
    """SELECT doc_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM documents LEFT JOIN embeddings ON vec_id = doc_id, range(1, 65) r(i)
      WHERE embedding IS NOT NULL OR i = 1""",
)
def _(t: Tables):
    known = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    joined = generate.known_vectors(t.documents.select("doc_id"), known, "doc_id")
    cells = joined.select("doc_id", F.posexplode_outer("embedding").alias("i", "x"))
    return cells.select("doc_id", F.coalesce("i", F.lit(0)).cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@check(
    "unit_vectors",
    """SELECT vec_id, i - 1 AS i, round(x / nullif(n, 0), 6) AS x FROM (
        SELECT vec_id, i, (CASE WHEN vec_id % 50 = 0 THEN 0 ELSE 3 * embedding[i]::DOUBLE END) AS x,
          sqrt(sum(CASE WHEN vec_id % 50 = 0 THEN 0 ELSE 9 * embedding[i]::DOUBLE ** 2 END) OVER (PARTITION BY vec_id)) AS n
        FROM embeddings, range(1, 65) r(i))""",
)
def _(t: Tables):
    factor = F.when(F.col("vec_id") % 50 == 0, 0.0).otherwise(3.0)
    scaled = F.transform(vx.to_double(F.col("embedding")), lambda x: x * factor)
    cells = t.embeddings.select("vec_id", F.posexplode(vx.unit(scaled)).alias("i", "x"))
    return cells.select("vec_id", F.col("i").cast("long").alias("i"), rounded("x").alias("x"))


@check(
    "pair_scores",
    with_views(
        "SELECT rewrite_id, round(abs(list_dot_product(a.v, b.v) ** 3), 6) AS score FROM rewrites JOIN a ON a.id = rewrite_id JOIN b ON b.id = rewrite_id",
        "rewrites",
        sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
        sql_vectors("b", "SELECT rewrite_id AS id, rewritten_text AS text FROM rewrites"),
    ),
)
def _(t: Tables):
    pairs = t.rewrites.select(
        "rewrite_id", vx.encode_text(F.col("rewrite_prompt")).alias("a"), vx.encode_text(F.col("rewritten_text")).alias("b")
    )
    return scoring.pair_scores(pairs, "a", "b").select("rewrite_id", rounded("score").alias("score"))


@check(
    "aligned_metric",
    with_views(
        "SELECT round(avg(list_dot_product(a.v, b.v) ** 3), 6) AS metric, round(avg(abs(list_dot_product(a.v, b.v) ** 3)), 6) AS mean_score FROM a JOIN b USING (id)",
        "rewrites",
        sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
        sql_vectors("b", "SELECT rewrite_id AS id, rewritten_text AS text FROM rewrites"),
    ),
)
def _(t: Tables):
    from palimpsest.operators.evaluate import aligned_metric, mean_score

    pairs = t.rewrites.select(
        "rewrite_id", vx.encode_text(F.col("rewrite_prompt")).alias("a"), vx.encode_text(F.col("rewritten_text")).alias("b")
    )
    plain = mean_score(scoring.pair_scores(pairs, "a", "b")).select("mean_score").scalar()
    return aligned_metric(pairs, "a", "b").select(rounded("metric").alias("metric"), rounded(plain).alias("mean_score"))


@check(
    "prompt_score",
    with_views(
        "SELECT round(avg(list_dot_product(pv.v, c.v) ** 3), 9) AS score FROM pv, c",
        *_PROMPTS,
        sql_vectors("c", "SELECT 0 AS id, 'rewrite this text in the style of' AS text"),
    ),
)
def _(t: Tables):
    # the constant is encoded once, not once for each row of the corpus
    encoded = t.spark.range(1).select(vx.encode_text(F.lit("rewrite this text in the style of")).alias("v")).first()["v"]
    return scoring.prompt_score(vx.vector_literal(encoded), t.prompt_vectors).select(rounded("score", 9).alias("score"))


_SCORES = "scores AS (SELECT bv.id, avg(list_dot_product(pv.v, bv.v) ** 3) AS score FROM bv, pv GROUP BY bv.id)"


@check("candidate_scores", with_views("SELECT id, round(score, 9) AS score FROM scores", *_PROMPTS, _BENCH, _SCORES))
def _(t: Tables):
    scores = scoring.mean_cubed_similarity(t.benchmark_vectors, t.prompt_vectors, "id")
    return scores.select("id", rounded("score", 9).alias("score"))


@check("candidate_scores_in_passes", with_views("SELECT id, round(score, 9) AS score FROM scores", *_PROMPTS, _BENCH, _SCORES))
def _(t: Tables):
    scores = scoring.mean_cubed_similarity(t.benchmark_vectors, t.prompt_vectors, "id", way="passes")
    return scores.select("id", rounded("score", 9).alias("score"))


@check(
    "top_fraction_of_candidates",
    with_views(
        "SELECT id FROM scores ORDER BY round(score, 9) DESC, id LIMIT (SELECT CAST(floor(0.2 * count(*)) AS BIGINT) FROM scores)",
        *_PROMPTS,
        _BENCH,
        _SCORES,
    ),
)
def _(t: Tables):
    scores = scoring.mean_cubed_similarity(t.benchmark_vectors, t.prompt_vectors, "id")
    return scoring.top_fraction(scores, 0.2, [F.desc(F.round("score", 9)), F.col("id")]).select("id")


@check("centroids", with_views("SELECT label, i - 1 AS i, round(x, 6) AS x FROM cells", _UNITS, _CENTRES))
def _(t: Tables):
    cells = _label_centres(t).select("label", F.posexplode("centroid").alias("i", "x"))
    return cells.select("label", F.col("i").cast("long").alias("i"), rounded("x").alias("x"))


@check(
    "rank_by_centroid_distance",
    with_views(
        """SELECT id, round(sqrt(d), 6) AS distance, row_number() OVER (ORDER BY round(sqrt(d), 6), id) - 1 AS place
        FROM (SELECT id, sum((v[i] - x) ** 2) AS d FROM units, (SELECT i, avg(v[i]) AS x FROM units, range(1, 65) r(i) GROUP BY i) m GROUP BY id)""",
        _UNITS,
    ),
)
def _(t: Tables):
    from palimpsest.operators.ordering import with_position

    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    ranked = scoring.distance_to_centroid(rows, "embedding").select("id", rounded("distance").alias("distance"))
    return with_position(ranked, "distance", "place", ["id"])


@check(
    "mean_similarity_to_all",
    with_views(
        """SELECT a.id, round(avg(list_dot_product(a.v, b.v)), 6) AS plain, round(avg(list_dot_product(a.v, b.v) ** 3), 6) AS cubed
        FROM units a, units b GROUP BY a.id""",
        _UNITS,
    ),
)
def _(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    plain = scoring.mean_similarity_to_all(rows, "embedding", cubed=False).withColumnRenamed("score", "plain")
    cubed = scoring.mean_similarity_to_all(rows, "embedding").withColumnRenamed("score", "cubed")
    return plain.join(cubed, "id").select("id", rounded("plain").alias("plain"), rounded("cubed").alias("cubed"))


@check(
    "similarity_matrix",
    with_views(
        "SELECT pv.id, bv.id AS item_id, round(list_dot_product(pv.v, bv.v), 6) AS similarity FROM pv, bv", *_PROMPTS, _BENCH
    ),
)
def _(t: Tables):
    items = t.benchmark_vectors.withColumnRenamed("id", "item_id")
    rows = scoring.similarity_rows(t.prompt_vectors, "id", "vector", items, "item_id", "vector")
    return rows.withColumn("similarity", rounded("similarity"))


@check(
    "nearest_rows",
    with_views(
        """SELECT query, neighbour, round(s, 6) AS similarity, rank FROM (
          SELECT bv.id AS query, pv.id AS neighbour, list_dot_product(pv.v, bv.v) AS s,
            row_number() OVER (PARTITION BY bv.id ORDER BY round(list_dot_product(pv.v, bv.v), 12) DESC, pv.id) AS rank FROM pv, bv)
        WHERE rank <= 5""",
        *_PROMPTS,
        _BENCH,
    ),
)
def _(t: Tables):
    found = scoring.nearest_rows(t.benchmark_vectors, t.prompt_vectors, "id", "id", "vector", 5)
    return found.select("query", "neighbour", rounded("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


# the same planes, buckets and probes as the library's, then the recall against all pairs
_LSH = f"""size AS MATERIALIZED (SELECT greatest(1, ceil(log2(greatest(2, count(*) / 64))))::BIGINT AS bits FROM (SELECT DISTINCT v FROM pv)),
planes AS MATERIALIZED (SELECT t, b, list(('0x' || substr(md5('plane#' || t || '#' || b || '#' || i), 1, 4))::BIGINT / 32768::DOUBLE - 1 ORDER BY i) AS c
  FROM range(12) t(t), range(12) b(b), range(16) i(i), size WHERE b < bits GROUP BY t, b),
cut AS MATERIALIZED (SELECT kind, id, t, b, list_dot_product(v, c) AS x FROM (SELECT 'p' AS kind, * FROM pv UNION ALL SELECT 'q', * FROM bv), planes),
coded AS MATERIALIZED (SELECT kind, id, t, sum(CASE WHEN x >= 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM cut GROUP BY kind, id, t),
crossed AS (SELECT id, t, 0::BIGINT AS mask, 0::DOUBLE AS cost FROM coded WHERE kind = 'q'
  UNION ALL SELECT id, t, (1 << b)::BIGINT, round(abs(x), 12) FROM cut WHERE kind = 'q'
  UNION ALL SELECT c.id, c.t, ((1 << c.b) | (1 << d.b))::BIGINT, round(abs(c.x) + abs(d.x), 12) FROM cut c JOIN cut d ON c.kind = 'q' AND d.kind = 'q' AND c.id = d.id AND c.t = d.t AND c.b < d.b),
probed AS (SELECT id, t, mask FROM (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY cost, bit_count(mask), mask) AS r FROM crossed) WHERE r <= {{probes}}),
pairs AS (SELECT DISTINCT q.id AS query, p.id AS neighbour FROM probed q JOIN coded k ON k.kind = 'q' AND k.id = q.id AND k.t = q.t
  JOIN coded p ON p.kind = 'p' AND p.t = q.t AND p.code = xor(k.code, q.mask)),
near AS (SELECT query, neighbour, similarity, rank FROM (SELECT query, neighbour, list_dot_product(bv.v, pv.v) AS similarity,
    row_number() OVER (PARTITION BY query ORDER BY round(list_dot_product(bv.v, pv.v), 12) DESC, neighbour) AS rank
  FROM pairs JOIN bv ON bv.id = query JOIN pv ON pv.id = neighbour) WHERE rank <= 5),
exact AS (SELECT query, neighbour FROM (SELECT bv.id AS query, pv.id AS neighbour,
    row_number() OVER (PARTITION BY bv.id ORDER BY round(list_dot_product(bv.v, pv.v), 12) DESC, pv.id) AS rank FROM bv, pv) WHERE rank <= 5)"""


@check(
    "approximate_nearest_rows",
    with_views(
        """SELECT query, neighbour, round(similarity, 6) AS similarity, rank,
          (SELECT avg(CASE WHEN n.query IS NULL THEN 0 ELSE 1 END) >= 0.95 FROM exact LEFT JOIN near n USING (query, neighbour)) AS recall_reached FROM near""",
        *_PROMPTS,
        _BENCH,
        _LSH.format(probes=neighbours.PROBES),
    ),
)
def _(t: Tables):
    corpus, asked = cut_lineage(t.prompt_vectors), cut_lineage(t.benchmark_vectors)
    found = cut_lineage(neighbours.approximate_rows(asked, corpus, "id", "id", "vector", 5))
    reached = neighbours.recall(found, scoring.nearest_rows(asked, corpus, "id", "id", "vector", 5)) >= 0.95
    columns = [rounded("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"), F.lit(reached).alias("recall_reached")]
    return found.select("query", "neighbour", *columns)


@check(
    "nearest_centre",
    with_views(
        """SELECT id, nearest, round(distance, 6) AS distance FROM (SELECT id, c.label AS nearest,
            sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c.c[i]) ** 2))) AS distance,
            row_number() OVER (PARTITION BY id ORDER BY sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c.c[i]) ** 2))), c.label) AS r
          FROM units, centres c) WHERE r = 1""",
        _UNITS,
        _CENTRES,
    ),
)
def _(t: Tables):
    centres = _label_centres(t).select(F.col("label").alias("cluster"), F.col("centroid").alias("centre"))
    placed = clusters.nearest_centre(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "embedding", centres)
    return placed.select("id", "nearest", rounded("distance").alias("distance"))


@check(
    "most_typical_20",
    with_views(
        """SELECT id FROM (SELECT id, min(sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c.c[i]) ** 2)))) AS distance
          FROM units, centres c GROUP BY id) ORDER BY round(distance, 9), id LIMIT 20""",
        _UNITS,
        _CENTRES,
    ),
)
def _(t: Tables):
    centres = _label_centres(t).select(F.col("label").alias("cluster"), F.col("centroid").alias("centre"))
    placed = clusters.nearest_centre(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "embedding", centres)
    return clusters.most_typical(placed.withColumn("distance", F.round("distance", 9)), ("distance", "id")).select("id")


@check("pca_projection")
def _(t: Tables):
    return clusters.project(t.embeddings.select("vec_id", "embedding"), "embedding", 16).select("vec_id", "projected")


@check(
    "pca_keeps_distances",
    with_views(
        """SELECT id AS vec_id, round(sum((v[i] - x) ** 2), 6) AS squared FROM units, (SELECT i, avg(v[i]) AS x FROM units, range(1, 65) r(i) GROUP BY i) m
        GROUP BY id""",
        _UNITS,
    ),
)
def _(t: Tables):
    # with all components PCA is a rotation about the mean: squared lengths are squared distances to it
    full = clusters.project(t.embeddings.select("vec_id", "embedding"), "embedding", 64)
    return full.select("vec_id", rounded(vx.dot(F.col("projected"), F.col("projected"))).alias("squared"))


def _settled(labelled, centres, vector: str):
    """Whether each row is with its nearest centre, and that centre is the mean of its rows."""
    placed = clusters.nearest_centre(labelled, vector, centres)
    means = scoring.centroid(labelled, vector, ("cluster",))
    both = centres.join(means, "cluster").select("cluster", (vx.squared_distance(F.col("centre"), F.col("centroid")) < 1e-12).alias("is_mean"))
    own = placed.join(centres.select("cluster", F.col("centre").alias("_own")), "cluster").join(both, "cluster")
    distance = F.sqrt(vx.squared_distance(F.col(vector), F.col("_own")))
    return own.select("vec_id", (F.abs(distance - F.col("distance")) < 1e-9).alias("nearest"), "is_mean")


@check("kmeans_on_projection", "SELECT vec_id, true AS nearest, true AS is_mean FROM embeddings")
def _(t: Tables):
    projected = clusters.project(t.embeddings.select("vec_id", "embedding"), "embedding", 32).select("vec_id", "projected")
    labelled, centres = clusters.kmeans(projected, "projected", 10, ids=("vec_id",), max_iter=60)
    return _settled(labelled, centres, "projected")


def _sql_lloyd(steps: int) -> list[str]:
    """Assignments and centres step by step from the rows that come first in the seeded order."""
    views = [
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {sql_key(0, 'id')}, id) - 1 AS cluster, v AS c FROM units
          QUALIFY cluster < greatest(2, (SELECT count(*) FROM units) // 100))"""
    ]
    distance = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) ** 2))"
    for step in range(steps + 1):
        views.append(
            f"""a{step} AS MATERIALIZED (SELECT id, any_value(v) AS v, arg_min(cluster, struct_pack(d := {distance}, k := cluster)) AS cluster
            FROM units, c{step} GROUP BY id)"""
        )
        if step < steps:
            views += [
                f"m{step} AS (SELECT cluster, list(x ORDER BY i) AS m FROM (SELECT cluster, i, avg(v[i]) AS x FROM a{step}, range(1, 65) r(i) GROUP BY cluster, i) GROUP BY cluster)",
                f"c{step + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{step} LEFT JOIN m{step} USING (cluster))",
            ]
    return views


@check("kmeans_per_hundred_rows", with_views("SELECT id AS vec_id, cluster FROM a20", _UNITS, *_sql_lloyd(20)))
def _(t: Tables):
    rows = t.embeddings.select("vec_id", "embedding")
    labelled, _ = clusters.kmeans(rows, "embedding", clusters.clusters_for(rows.count()), ids=("vec_id",))
    return labelled.select("vec_id", F.col("cluster").cast("long").alias("cluster"))


_EPS = 0.3


@check(
    "density_clusters",
    with_views(
        f"""SELECT dv.id, coalesce(core.label, (SELECT min(k.label) FROM pairs p JOIN labels_ k ON k.id = p.b WHERE p.a = dv.id), -1) AS cluster
        FROM dv LEFT JOIN labels_ core USING (id)""",
        sql_vectors("dv", "SELECT doc_id AS id, text FROM documents"),
        f"""pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM dv a, dv b
            WHERE 2 - 2 * list_dot_product(a.v, b.v) <= {_EPS} * {_EPS} + 1e-12)""",
        "core AS MATERIALIZED (SELECT a AS id FROM pairs GROUP BY a HAVING count(*) >= 5)",
        "core_pairs AS MATERIALIZED (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core))",
        """reach(id, root) AS (SELECT a, b FROM core_pairs UNION SELECT r.id, p.b FROM reach r JOIN core_pairs p ON p.a = r.root)""",
        "labels_ AS MATERIALIZED (SELECT id, min(root) AS label FROM reach GROUP BY id)",
        recursive=True,
    ),
)
def _(t: Tables):
    return density.density_clusters(t.document_vectors, "id", "vector", _EPS, 5)


_FOUND = "round(start_score, 6) AS start_score, true AS improved, true AS settled"


def _improved(found):
    improved = (F.col("score") > F.col("start_score")).alias("improved")
    return found.select("grp", rounded("start_score").alias("start_score"), improved, (F.col("residual") < 1e-6).alias("settled"))


@check(
    "best_direction",
    with_views(f"SELECT 0 AS grp, {_FOUND} FROM (SELECT avg((list_sum(v) / 8) ** 3) AS start_score FROM units)", _UNITS),
)
def _(t: Tables):
    found = clusters.best_direction(t.embeddings, "embedding", [1.0] * 64, alpha=None, max_iter=2_000)
    return _improved(found)


@check(
    "best_direction_per_cluster",
    with_views(f"SELECT grp, {_FOUND} FROM (SELECT label AS grp, avg((list_sum(v) / 8) ** 3) AS start_score FROM units GROUP BY label)", _UNITS),
)
def _(t: Tables):
    found = clusters.best_direction(t.embeddings, "embedding", [1.0] * 64, group="label", alpha=None, max_iter=2_000)
    return _improved(found)
