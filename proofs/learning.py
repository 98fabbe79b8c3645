"""Splits, features, classifiers, evaluation and running means."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofs.registry import Tables, proof, rounded
from proofs.texts import TOKENS_SQL, clean_sql
from shoplore.functions import columns
from shoplore.functions.text import words
from shoplore.operators import evaluation, features, models, ordered
from shoplore.plans.reviews import compare_models, prepared_reviews
from shoplore.session import checkpointed, shared_path
from shoplore.sources import files


def _reviews(t: Tables):
    """Labelled documents as reviews: good ones scored 5, others 1."""
    scores = t.labels.select("doc_id", (1 + 4 * F.col("quality")).alias("score"))
    return t.documents.select("doc_id", "text").join(scores, "doc_id")


SPLIT_SQL = """
sizes AS (SELECT quality, count(*) AS n, sum(count(*)) OVER () AS total FROM labels GROUP BY 1),
wanted AS (SELECT *, CAST(floor(0.1 * total) AS BIGINT) AS want FROM sizes),
test_q AS (SELECT *, floor(n * want / total::DOUBLE) AS base,
           row_number() OVER (ORDER BY n * want / total::DOUBLE - floor(n * want / total::DOUBLE) DESC, quality)
           AS turn FROM wanted),
test_n AS (SELECT *, base + CASE WHEN turn <= want - sum(base) OVER () THEN 1 ELSE 0 END AS tests FROM test_q),
left_q AS (SELECT quality, tests, want, n - tests AS rest, sum(n - tests) OVER () AS total FROM test_n),
val_q AS (SELECT *, floor(rest * want / total::DOUBLE) AS base,
          row_number() OVER (ORDER BY rest * want / total::DOUBLE - floor(rest * want / total::DOUBLE) DESC, quality)
          AS turn FROM left_q),
quotas AS (SELECT quality, tests, base + CASE WHEN turn <= want - sum(base) OVER () THEN 1 ELSE 0 END AS vals
           FROM val_q),
numbered AS (SELECT doc_id, quality, row_number() OVER (
             PARTITION BY quality ORDER BY md5('808:' || doc_id), doc_id) AS place FROM labels),
split AS (SELECT doc_id, numbered.quality, CASE WHEN place <= tests THEN 'test'
          WHEN place <= tests + vals THEN 'validation' ELSE 'train' END AS split
          FROM numbered JOIN quotas ON quotas.quality = numbered.quality)
"""


@proof(f"WITH {SPLIT_SQL} SELECT doc_id, quality, split FROM split")
def stratified_split(t: Tables):
    return features.stratified_split(t.labels.select("doc_id", "quality"), "doc_id", "quality")


@proof(f"WITH {SPLIT_SQL} SELECT split.doc_id, quality, split, text FROM split JOIN documents USING (doc_id)")
def csv_splits(t: Tables):
    """The splits with their texts, written as CSV folders and read back."""
    split = features.stratified_split(t.labels.select("doc_id", "quality"), "doc_id", "quality")
    rows = checkpointed(split.join(t.documents.select("doc_id", "text"), "doc_id"))
    folder, names = shared_path(t.spark, "splits"), ("train", "validation", "test")
    files.write_splits({n: rows.filter(F.col("split") == n) for n in names}, folder)
    return reduce(DataFrame.unionByName, [files.read_csv(t.spark, f"{folder}/{n}", rows.schema, multiline=True) for n in names])


@proof("SELECT doc_id, CAST(quality = 1 AS INTEGER) AS label FROM labels")
def binary_label(t: Tables):
    return t.labels.select("doc_id", columns.binary_label(columns.sentiment(1 + 4 * F.col("quality"))).alias("label"))


def tfidf_sql(name: str, source: str) -> str:
    """TF-IDF weights of ``source(doc_id, text)`` with the vocabulary of its own texts."""
    return f"""
{name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM
              (SELECT doc_id, {TOKENS_SQL} AS term FROM {source}) GROUP BY ALL),
{name}_n AS (SELECT count(*) AS docs FROM {source}),
{name}_vocab AS (SELECT term, ln((1 + any_value(docs)) / (1.0::DOUBLE + count(*))) + 1 AS idf
                 FROM {name}_tf, {name}_n GROUP BY term
                 HAVING count(*) >= 0.0001 * any_value(docs) AND count(*) <= 0.8 * any_value(docs)
                 ORDER BY sum(tf) DESC, term LIMIT 100000)
"""


def weights_sql(counts: str, vocabulary: str) -> str:
    return f"""(SELECT doc_id, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS weight
FROM {counts} JOIN {vocabulary} USING (term))"""


@proof(f"""
WITH {tfidf_sql('d', 'documents')}
SELECT doc_id, term, tf, round(weight, 6) AS weight FROM {weights_sql('d_tf', 'd_vocab')}
""")
def tfidf(t: Tables):
    stored = checkpointed(t.documents.select("doc_id", words("text").alias("terms")))
    fitted = features.fit_tfidf(stored, "terms", terms=F.col)
    return rounded(fitted.weights(stored, ["doc_id"], "terms"), "weight")


@proof("""
SELECT quality, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE) AS weight
FROM labels GROUP BY 1
""")
def class_weights(t: Tables):
    return features.class_weights(t.labels, "quality")


def _prepared(t: Tables):
    """Labelled, cleaned and split texts; their terms are what is stored."""
    return prepared_reviews(_reviews(t), "doc_id", "score", "text")


@proof()
def logreg_predictions(t: Tables):
    return compare_models(_prepared(t), "doc_id", fit=["logistic"]).logistic


@proof()
def model_comparison(t: Tables):
    return compare_models(_prepared(t), "doc_id").reports()


@proof(f"""
WITH {SPLIT_SQL},
prepared AS (SELECT doc_id, quality, split, {clean_sql('text')} AS text FROM documents JOIN split USING (doc_id)),
train AS (SELECT * FROM prepared WHERE split = 'train'),
judged AS (SELECT * FROM prepared WHERE split = 'validation'),
{tfidf_sql('t', 'train')},
train_w AS (SELECT w.*, quality FROM {weights_sql('t_tf', 't_vocab')} w JOIN train USING (doc_id)),
term_sums AS (SELECT term, coalesce(sum(weight) FILTER (quality = 0), 0) AS s0,
              coalesce(sum(weight) FILTER (quality = 1), 0) AS s1 FROM train_w GROUP BY 1),
mass AS (SELECT count(*) AS v, sum(s0) AS m0, sum(s1) AS m1 FROM term_sums),
logp AS (SELECT term, ln((s0 + 1) / (m0 + v)) AS l0, ln((s1 + 1) / (m1 + v)) AS l1 FROM term_sums, mass),
prior AS (SELECT ln(avg(1 - quality)) AS p0, ln(avg(quality)) AS p1 FROM train),
judged_tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {TOKENS_SQL} AS term FROM judged) GROUP BY ALL),
sums AS (SELECT doc_id, sum(weight * l0) AS s0, sum(weight * l1) AS s1
         FROM {weights_sql('judged_tf', 't_vocab')} JOIN logp USING (term) GROUP BY 1),
scores AS (SELECT judged.doc_id, coalesce(s0, 0) + p0 AS score_0, coalesce(s1, 0) + p1 AS score_1
           FROM judged LEFT JOIN sums USING (doc_id), prior)
SELECT doc_id, round(score_0, 6) AS score_0, round(score_1, 6) AS score_1,
       CASE WHEN score_0 >= score_1 THEN 0 ELSE 1 END AS predicted FROM scores
""")
def naive_bayes(t: Tables):
    prepared = prepared_reviews(_reviews(t), "doc_id", "score", "text")
    stored = checkpointed(prepared.select("doc_id", "label", "split", words("text").alias("terms")))
    train, judged = (stored.filter(F.col("split") == s) for s in ("train", "validation"))
    fitted = features.fit_tfidf(train, "terms", terms=F.col)
    model = models.fit_term_matrix(fitted.vectors(train, "terms"), "features", "label")
    scores = model.predict(fitted.vectors(judged, "terms"), "features")
    return rounded(scores.select("doc_id", "score_0", "score_1", "predicted"), "score_0", "score_1")


@proof("""
WITH flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i
              FROM embeddings),
centre AS (SELECT label AS candidate, i, avg(v) AS c FROM flat GROUP BY ALL),
gaps AS (SELECT vec_id, label, candidate, sum((v - c) * (v - c)) AS d FROM flat JOIN centre USING (i) GROUP BY ALL)
SELECT vec_id, label, CAST(arg_min(candidate, d) AS INTEGER) AS predicted FROM gaps GROUP BY ALL
""")
def batch_score(t: Tables):
    """Nearest class centre. The model is one vector per class, fitted on the table itself."""
    vector = array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
    sizes = features.label_sizes(t.embeddings, "label")
    centres = (t.embeddings.groupBy("label").agg(vector_to_array(Summarizer.mean(vector)).alias("c"))
               .orderBy("label").collect())
    assert len(centres) == len(sizes)
    classes, points = [r["label"] for r in centres], [r["c"] for r in centres]

    def make_predict():
        import numpy as np

        names, table = np.array(classes, dtype="int32"), np.array(points)

        def predict(batch):
            gaps = ((batch.astype("float64")[:, None, :] - table[None, :, :]) ** 2).sum(axis=2)
            return names[gaps.argmin(axis=1)]

        return predict

    scored = models.batch_score(t.embeddings.select("vec_id", "label", "embedding"), "embedding",
                                make_predict, T.IntegerType(), "predicted", shapes=[[len(points[0])]])
    return scored.drop("embedding")


CELLS_SQL = """
cells AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp,
                 count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
                 count(*) FILTER (quality = 1 AND toxic = 0) AS fn,
                 count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
"""


@proof(f"""
WITH {CELLS_SQL}, r AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision,
                        tp / (tp + fn) AS recall FROM cells)
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r
""")
def binary_metrics(t: Tables):
    return rounded(evaluation.binary_metrics(t.labels, "quality", "toxic"),
                   "accuracy", "precision", "recall", "f1")


@proof(f"""
WITH {CELLS_SQL},
r AS (SELECT '1' AS class, tp / (tp + fp) AS p, tp / (tp + fn) AS r, tp + fn AS support FROM cells
      UNION ALL SELECT '0', tn / (tn + fn)::DOUBLE, tn / (tn + fp)::DOUBLE, tn + fp FROM cells),
f AS (SELECT *, 2 * p * r / (p + r) AS f FROM r),
report AS (SELECT class, p, r, f, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM cells
UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
          sum(f * support) / sum(support), sum(support) FROM f)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM report
""")
def classification_report(t: Tables):
    return rounded(evaluation.classification_report(t.labels, "quality", "toxic"),
                   "precision", "recall", "f1")


@proof("""
SELECT quality AS actual, count(*) FILTER (toxic = 0) AS predicted_0,
       count(*) FILTER (toxic = 1) AS predicted_1, CAST(0 AS BIGINT) AS predicted_other FROM labels GROUP BY 1
""")
def confusion_matrix(t: Tables):
    return evaluation.confusion_matrix(t.labels, "quality", "toxic")


@proof("""
WITH RECURSIVE placed AS (SELECT user_id, event_id, sqrt(value) AS value, row_number() OVER (
    PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
run AS (SELECT user_id, event_id, i, value AS ewma FROM placed WHERE i = 1
        UNION ALL SELECT p.user_id, p.event_id, p.i, 0.95 * run.ewma + (1 - 0.95) * p.value
        FROM run JOIN placed p ON p.user_id = run.user_id AND p.i = run.i + 1)
SELECT user_id, event_id, round(ewma, 6) AS ewma FROM run
""")
def ewma_by_key(t: Tables):
    # square roots, because means of whole cents would often end in an exact half
    series = t.events.select("user_id", "event_id", "ts", F.sqrt("value").alias("value"))
    means = ordered.ewma_by_key(series, "user_id", ["ts", "event_id"], "value", decay=0.95)
    return rounded(means.select("user_id", "event_id", "ewma"), "ewma")


@proof("""
WITH RECURSIVE m AS (
  SELECT CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_quantity AS DOUBLE) / 50 AS x,
         sum(CASE WHEN l_returnflag = 'R' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS n,
         sum(CASE WHEN l_returnflag = 'R' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) AS k FROM lineitem GROUP BY 1, 2),
newton AS (
  SELECT 0 AS step, 0.0::DOUBLE AS c, 0.0::DOUBLE AS i
  UNION ALL
  SELECT step + 1, c - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), i - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01)
  FROM (SELECT step, c, i, c + sum(x * (n * p - k)) AS g1, sum(n * p - k) AS g0, 1 + sum(n * p * (1 - p) * x * x) AS h11,
               sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p)) AS h00
        FROM (SELECT step, c, i, x, n, k, 1 / (1 + exp(-(c * x + i))) AS p FROM newton, m WHERE step < 12) GROUP BY step, c, i))
SELECT quantity, round(1 / (1 + exp(-(c * x + i))), 4) AS probability, round(c, 4) AS coefficient, round(i, 4) AS intercept
FROM m, newton WHERE step = 12
""")
def logreg_one_measure(t: Tables):
    """One measure, an intercept and weights: SQL finds the same fit by Newton steps."""
    rows = t.lineitem.select(
        array_to_vector(F.array(F.col("l_quantity").cast("double") / 50)).alias("x"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.when(F.col("l_returnflag") == "R", 2.0).otherwise(1.0).alias("w"))
    model = models.fit_logistic(rows, "x", "y", "w", tolerance=1e-8)
    kinds = t.lineitem.select(F.col("l_quantity").cast("double").alias("quantity")).distinct()
    told = model.predict(kinds.withColumn("x", array_to_vector(F.array(F.col("quantity") / 50))), "x")
    return told.select("quantity", F.round("probability", 4).alias("probability"),
                       F.round(F.lit(model.coefficients[0]), 4).alias("coefficient"),
                       F.round(F.lit(model.intercept), 4).alias("intercept"))
