"""Scaling and clustering of customer profiles."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from proofs.customers import MEASURES, RFM_SQL, SCORES_SQL, measures, profile, scored
from proofs.registry import Tables, proof, rounded
from shoplore.operators import clustering, quality, rfm as profiles, scaling
from shoplore.plans.segmentation import exact_silhouette
from shoplore.session import checkpointed

NORMED = [f"norm_{m}" for m in MEASURES]


def _all_measures(expression: str) -> str:
    return ", ".join(f"round({expression.format(m=m)}, 6) AS norm_{m}" for m in MEASURES)


@proof(f"""
WITH {RFM_SQL}
SELECT o_custkey, {_all_measures('({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER ()')} FROM rfm
""")
def standard_scale(t: Tables):
    rows = measures(t)
    scaled = scaling.apply_scale(rows, scaling.fit_standard(rows, MEASURES))
    return rounded(scaled.select("o_custkey", *NORMED), *NORMED)


@proof(f"""
WITH {RFM_SQL}, q AS (SELECT {", ".join(f"quantile_cont(CAST({m} AS DOUBLE), {p}) AS {m}_{n}" for m in MEASURES
                                        for n, p in (("low", 0.25), ("mid", 0.5), ("high", 0.75)))} FROM rfm)
SELECT o_custkey, {_all_measures('({m} - {m}_mid) / ({m}_high - {m}_low)')} FROM rfm, q
""")
def robust_scale(t: Tables):
    rows = measures(t)
    scaled = scaling.apply_scale(rows, scaling.fit_robust(rows, MEASURES))
    return rounded(scaled.select("o_custkey", *NORMED), *NORMED)


@proof(f"""
WITH {RFM_SQL}, grid AS (SELECT i / 20.0::DOUBLE AS power FROM range(-40, 41) AS r(i)),
m AS (SELECT ln(monetary) AS lx, ln(monetary) - avg(ln(monetary)) OVER () AS z FROM rfm),
changed AS (SELECT power, lx, CASE WHEN power = 0 THEN z ELSE (exp(power * z) - 1) / power END AS y
            FROM grid, m)
SELECT power, round(-sum(lx) - count(*) / 2.0 * ln(var_pop(y)), 3) AS loglik
FROM changed GROUP BY power
""")
def boxcox_loglik(t: Tables):
    powers = [i / 20 for i in range(-40, 41)]
    table = scaling.box_cox_log_likelihood(measures(t), "monetary", powers)
    return rounded(table, "loglik", places=3)


def _power_sql(measure: str) -> str:
    """Grids of step 0.1, 0.01 and 0.001, each around the best point before it, then the top of the
    parabola through the last three points."""
    likelihood = ("-avg(lx) * count(*) - count(*) / 2.0 * ln(var_pop(CASE WHEN abs(power) < 1e-12 THEN z"
                  " ELSE (exp(power * z) - 1) / power END))")
    ctes = [f"{measure}_z AS (SELECT ln({measure}) AS lx, ln({measure}) - avg(ln({measure})) OVER () AS z"
            " FROM rfm)"]
    centre, reach = "0.0", 20
    for level, step in enumerate((0.1, 0.01, 0.001)):
        ctes.append(f"""{measure}_{level} AS (SELECT power, {likelihood} AS ll FROM {measure}_z,
(SELECT round({centre} + i * {step}, 6) AS power FROM range({-reach}, {reach + 1}) AS r(i)) GROUP BY power)""")
        centre, reach = f"(SELECT arg_max(power, ll) FROM {measure}_{level})", 10
    ctes.append(f"""{measure}_p AS (SELECT power + 0.001 * (before - after) / (2 * (before - 2 * ll + after))
AS power FROM (SELECT *, lag(ll) OVER (ORDER BY power) AS before, lead(ll) OVER (ORDER BY power) AS after
FROM {measure}_2) ORDER BY ll DESC LIMIT 1)""")
    return ",\n".join(ctes)


@proof(f"""
WITH {RFM_SQL}, {", ".join(_power_sql(m) for m in MEASURES)},
changed AS (SELECT o_custkey, {", ".join(f"(pow({m}, {m}_p.power) - 1) / {m}_p.power AS {m}" for m in MEASURES)}
            FROM rfm, {", ".join(f"{m}_p" for m in MEASURES)})
SELECT o_custkey, {", ".join(f"round(({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER (), 4) AS norm_{m}"
                             for m in MEASURES)} FROM changed
""")
def boxcox_apply(t: Tables):
    rows = measures(t)
    scaled = scaling.apply_scale(rows, scaling.fit_box_cox(rows, MEASURES))
    return rounded(scaled.select("o_custkey", *NORMED), *NORMED, places=4)


def _normal(t: Tables):
    """The scaled profile that is clustered, stored because every fit reads it."""
    rows = measures(t)
    return checkpointed(scaling.apply_scale(rows, scaling.fit_box_cox(rows, MEASURES)))


@proof()
def kmeans_labels(t: Tables):
    rows = _normal(t)
    return clustering.kmeans(rows, NORMED, 6).label(rows)


@proof()
def cluster_centres(t: Tables):
    rows = _normal(t)
    return clustering.centres_table(rows, clustering.kmeans(rows, NORMED, 6))


@proof()
def elbow_curve(t: Tables):
    rows = _normal(t)
    return clustering.elbow_table(rows, clustering.kmeans_sweep(rows, NORMED, range(2, 9)))


@proof()
def silhouette_curve(t: Tables):
    rows = scored(t)
    sweep = clustering.kmeans_sweep(rows, list(profiles.SCORES), range(2, 9))
    return clustering.silhouette_table(rows, list(profiles.SCORES), sweep)


@proof()
def elbow_curve_scores(t: Tables):
    sweep = clustering.kmeans_sweep(scored(t), list(profiles.SCORES), range(2, 9))
    return clustering.elbow_table(t.orders, sweep)


@proof()
def silhouette_curve_normal(t: Tables):
    rows = _normal(t)
    return clustering.silhouette_table(rows, NORMED, clustering.kmeans_sweep(rows, NORMED, range(2, 9)))


TIER_SQL = """CASE WHEN score_recency + score_frequency + score_monetary <= 7 THEN 0
WHEN score_recency + score_frequency + score_monetary <= 11 THEN 1 ELSE 2 END"""


def _tiers(t: Tables):
    """Segments by total score, a rule that SQL can repeat."""
    total = profiles.total_score(scored(t))
    return total.withColumn("cluster", F.when(F.col("score_total") <= 7, 0)
                            .when(F.col("score_total") <= 11, 1).otherwise(2))


@proof(f"""
WITH {SCORES_SQL}, labelled AS (SELECT *, {TIER_SQL} AS cluster FROM scored),
points AS (SELECT cluster, score_recency AS r, score_frequency AS f, score_monetary AS m, count(*) AS n
           FROM labelled GROUP BY ALL),
sizes AS (SELECT cluster, sum(n) AS size FROM points GROUP BY 1),
sums AS (SELECT a.cluster, a.r, a.f, a.m, a.n, b.cluster AS other,
                sum(b.n * sqrt(pow(a.r - b.r, 2) + pow(a.f - b.f, 2) + pow(a.m - b.m, 2))) AS s
         FROM points a, points b GROUP BY ALL),
sides AS (SELECT sums.cluster, r, f, m, n,
                 max(CASE WHEN sums.cluster = other THEN s / (size - 1) END) AS a,
                 min(CASE WHEN sums.cluster <> other THEN s / size END) AS b
          FROM sums JOIN sizes ON sizes.cluster = other GROUP BY ALL)
SELECT round(sum(n * (b - a) / greatest(a, b)) / sum(n), 6) AS silhouette FROM sides
""")
def silhouette_exact(t: Tables):
    return rounded(exact_silhouette(_tiers(t), list(profiles.SCORES)), "silhouette")


@proof("""
WITH gaps AS (SELECT a.vec_id, a.label, b.label AS other,
  list_sum(list_transform(list_zip(a.embedding, b.embedding),
           lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) AS d
  FROM embeddings a, embeddings b),
sums AS (SELECT vec_id, label, other, sum(d) AS s, count(*) AS n FROM gaps GROUP BY ALL),
sides AS (SELECT vec_id, label, max(CASE WHEN label = other THEN s / (n - 1) END) AS a,
                 min(CASE WHEN label <> other THEN s / n END) AS b FROM sums GROUP BY ALL)
SELECT vec_id, label, round((b - a) / greatest(a, b), 6) AS silhouette FROM sides
""")
def silhouette_squared(t: Tables):
    points = clustering.silhouette_squared_points(t.embeddings, "embedding", "label")
    return rounded(points.select("vec_id", "label", "silhouette"), "silhouette")


@proof(f"""
WITH {RFM_SQL}, n AS (SELECT o_custkey, c_mktsegment, CAST(recency AS DOUBLE) AS recency,
                      CAST(frequency AS DOUBLE) AS frequency, monetary FROM rfm)
SELECT * FROM (UNPIVOT n ON recency, frequency, monetary INTO NAME measure VALUE value)
""")
def melt_rfm(t: Tables):
    return clustering.melt(profile(t), ["o_custkey", "c_mktsegment"], MEASURES)


@proof(f"""
WITH {SCORES_SQL}, labelled AS (SELECT *, {TIER_SQL} AS cluster FROM scored)
SELECT cluster, {", ".join(f"round(avg({m}), 6) AS {m}_mean, CAST(min({m}) AS DOUBLE) AS {m}_min, "
                           f"CAST(max({m}) AS DOUBLE) AS {m}_max" for m in MEASURES)}, count(*) AS size
FROM labelled GROUP BY 1
""")
def cluster_profile(t: Tables):
    table = quality.group_profile(_tiers(t), "cluster", MEASURES)
    return rounded(table, *[f"{m}_mean" for m in MEASURES])


@proof(f"""
WITH {RFM_SQL}, m AS (SELECT o_custkey, recency / 365.0::DOUBLE AS x, ln(monetary) AS y FROM rfm),
spread AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM m),
-- eigenvalues and eigenvectors of the symmetric matrix (a b; b c)
roots AS (SELECT a, b, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2
          FROM spread),
axes AS (SELECT l1 / (l1 + l2) AS share, b / sqrt(b * b + (l1 - a) ** 2) AS u1, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS u2,
                b / sqrt(b * b + (l2 - a) ** 2) AS v1, (l2 - a) / sqrt(b * b + (l2 - a) ** 2) AS v2 FROM roots)
SELECT o_custkey, round((x * u1 + y * u2) * sign(CASE WHEN abs(u1) >= abs(u2) THEN u1 ELSE u2 END), 6) AS pc1,
       round((x * v1 + y * v2) * sign(CASE WHEN abs(v1) >= abs(v2) THEN v1 ELSE v2 END), 6) AS pc2,
       round(share, 6) AS first_share FROM m, axes
""")
def pca_two_measures(t: Tables):
    """Two measures, for which SQL can say the components in closed form."""
    vectors = measures(t).select("o_custkey", (F.col("recency") / 365.0).alias("years"), F.ln("monetary").alias("spent"))
    found, shares = clustering.project(vectors, ["years", "spent"])
    return rounded(found.withColumn("first_share", F.lit(shares[0])).select("o_custkey", "pc1", "pc2", "first_share"),
                   "pc1", "pc2", "first_share")


@proof()
def pca_projection(t: Tables):
    vectors = t.embeddings.select("vec_id", "label", array_to_vector(
        F.transform("embedding", lambda v: v.cast("double"))).alias("v"))
    return rounded(clustering.project(vectors, "v")[0].drop("v"), "pc1", "pc2")


@proof(f"""
WITH {RFM_SQL}, m AS (SELECT CAST(frequency AS DOUBLE) AS x FROM rfm),
run AS (SELECT x, count(*) OVER w AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q, count(*) OVER () AS all_n,
               sum(x) OVER () AS all_s, sum(x * x) OVER () AS all_q,
               lead(x) OVER (ORDER BY x) AS above FROM m WINDOW w AS (ORDER BY x)),  -- equal values share a window
cuts AS (SELECT *, q - s * s / n + (all_q - q) - (all_s - s) * (all_s - s) / (all_n - n) AS cost
         FROM run WHERE n < all_n AND above > x),
best AS (SELECT * FROM cuts ORDER BY cost LIMIT 1)
SELECT 0 AS cluster, CAST(n AS BIGINT) AS members, round(s / n, 6) AS centre, round(cost, 3) AS cost FROM best
UNION ALL SELECT 1, CAST(all_n - n AS BIGINT), round((all_s - s) / (all_n - n), 6), round(cost, 3) FROM best
""")
def kmeans_two_groups(t: Tables):
    """Two clusters of one measure: the best cut of the sorted values."""
    rows = measures(t).select(F.col("frequency").cast("double").alias("x"))
    model = clustering.kmeans(rows, ["x"], 2, tolerance=0.0)
    found = model.label(rows).groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.avg("x").alias("centre"))
    return rounded(rounded(found.withColumn("cost", F.lit(model.cost)), "cost", places=3), "centre")


#: Fixed centres of (orders / 10, logarithm of the money spent), so that SQL can tell the clusters.
CENTRES = {2: [[0.8, 13.5], [2.0, 15.0]], 3: [[0.5, 13.0], [1.2, 14.2], [2.2, 15.2]]}


def _nearest_sql(k: int) -> str:
    gaps = ", ".join(f"pow(x - {x}, 2) + pow(y - {y}, 2)" for x, y in CENTRES[k])
    return f"SELECT {k} AS k, list_position([{gaps}], list_min([{gaps}])) AS cluster, x, y, o_custkey FROM m"


@proof(f"""
WITH {RFM_SQL}, m AS (SELECT o_custkey, frequency / 10.0::DOUBLE AS x, ln(CAST(monetary AS DOUBLE)) AS y FROM rfm),
labelled AS ({" UNION ALL ".join(_nearest_sql(k) for k in CENTRES)}),
sums AS (SELECT a.k, a.o_custkey, a.cluster, b.cluster AS other, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS s, count(*) AS n
         FROM labelled a JOIN labelled b ON a.k = b.k GROUP BY ALL),
sides AS (SELECT k, o_custkey, max(CASE WHEN cluster = other AND n > 1 THEN s / (n - 1) END) AS a,
                 min(CASE WHEN cluster <> other THEN s / n END) AS b FROM sums GROUP BY ALL)
SELECT k, round(avg(coalesce((b - a) / greatest(a, b), 0)), 2) AS silhouette, TRUE AS within FROM sides GROUP BY k
""")
def silhouette_euclidean(t: Tables):
    """Silhouettes of continuous measures by bounds over ball cells, next to all pairs in SQL."""
    rows = profile(t).select((F.col("frequency") / 10.0).alias("x"), F.log(F.col("monetary").cast("double")).alias("y"))
    sweep = {k: clustering.Clustering(("x", "y"), centres, 0.0) for k, centres in CENTRES.items()}
    table = clustering.euclidean_silhouette_table(rows, ["x", "y"], sweep, tolerance=5e-4)
    return rounded(table.select("k", "silhouette", (F.col("bound") <= 5e-4).alias("within")), "silhouette", places=2)
