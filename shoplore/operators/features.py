"""Splits, class weights and TF-IDF."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplore.functions.text import words
from shoplore.operators.ordered import with_row_number
from shoplore.session import checkpointed, shared_path
from shoplore.sources.files import create_table_as


def label_table(df: DataFrame, label: str) -> DataFrame:
    """``(label, n)``, checkpointed because what follows reads it several times."""
    sizes = checkpointed(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    if not sizes.filter(F.col(label).isNull()).isEmpty():
        raise ValueError(f"{label} has missing values")
    return sizes


def label_sizes(df: DataFrame, label: str) -> dict:
    """Rows per label in label order, for models that hold one parameter vector per class."""
    return {r[label]: r["n"] for r in label_table(df, label).orderBy(label).collect()}


def share_out(sizes: DataFrame, label: str, count: str, total: int, out: str) -> DataFrame:
    """Add ``total`` draws divided in proportion to ``count``, whole numbers, largest remainders first
    and of equal ones the first label. Labels are ranked by range partitions, however many there are."""
    population = sizes.agg(F.sum(count)).first()[0] or 1
    exact = F.col(count) * F.lit(total) / F.lit(float(population))
    parts = sizes.withColumns({"__base": F.floor(exact), "__rest": exact - F.floor(exact)})
    spare = total - (parts.agg(F.sum("__base")).first()[0] or 0)
    turns = with_row_number(parts.withColumn("__turn", -F.col("__rest")), ["__turn", label], "__place")
    return turns.withColumn(out, F.col("__base") + (F.col("__place") <= spare).cast("long")).drop(
        "__base", "__rest", "__turn", "__place")


def shuffle_hash(key: str, seed: int) -> Column:
    """A fixed random-looking order: the hash of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _stored_by_label(table: DataFrame) -> DataFrame:
    """A table with one row per label as a file. The planner knows its size and broadcasts it if it is small, so
    that the rows it is joined to stay where they are: by label they would meet in as many tasks as there are labels."""
    return create_table_as(table.coalesce(1), shared_path(table.sparkSession, "labels"))


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 808, share: float = 0.1,
                     out: str = "split") -> DataFrame:
    """Add ``train``, ``validation`` or ``test``. The last two hold ``int(share * rows)`` rows each and
    every label in proportion; ``key`` must be unique.

    Only label, hash and key are sorted, to find the hashes at which a label's splits end. Those
    bounds, one row per label, are joined to the rows, texts and all; a label that fills much of the
    table can be split at run time.
    """
    sizes = label_table(df, label)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    wanted = int(share * total)
    quotas = share_out(sizes, label, "n", wanted, "tests")
    quotas = share_out(quotas.withColumn("left", F.col("n") - F.col("tests")), label, "left", wanted, "vals")

    narrow = df.select(label, shuffle_hash(key, seed).alias("__hash"), key)
    numbered = with_row_number(narrow, [label, "__hash", key], "__place")
    begins = numbered.groupBy(label).agg(F.min("__place").alias("__first"))
    limits = quotas.join(begins, label).select(
        label, (F.col("__first") + F.col("tests") - 1).alias("__test"),
        (F.col("__first") + F.col("tests") + F.col("vals") - 1).alias("__val"), "__first")
    place, here = F.col("__place"), F.struct(F.col("__hash").alias("h"), F.col(key).alias("k"))
    # a split without rows has no row at its end, hence no bound
    bounds = (numbered.join(limits, label)
              .filter((place == F.col("__test")) | (place == F.col("__val")))
              .groupBy(label).agg(F.max(F.when(place == F.col("__test"), here)).alias("__test_end"),
                                  F.max(F.when(place == F.col("__val"), here)).alias("__val_end")))
    own = F.struct(shuffle_hash(key, seed).alias("h"), F.col(key).alias("k"))
    split = (F.when(F.coalesce(own <= F.col("__test_end"), F.lit(False)), "test")
             .when(F.coalesce(own <= F.col("__val_end"), F.lit(False)), "validation").otherwise("train"))
    return (df.join(_stored_by_label(bounds), label, "left").withColumn(out, split)
            .select(*df.columns, out))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with balanced weights: rows / (classes * rows of the class)."""
    sizes = label_table(df, label)
    facts = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    return sizes.select(label, "n", (F.lit(facts["rows"]) / (F.lit(facts["classes"]) * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Every row with the weight of its class; a class that fills much of the table can be split at run time."""
    return df.join(_stored_by_label(class_weights(df, label).select(label, F.col("weight").alias(out))), label)


@dataclass(frozen=True)
class Tfidf:
    """A fitted vocabulary ``(index, term, df, total, idf)`` and how to apply it; ``counter`` counts its
    terms and ``idf`` holds their weights in the same order.

    The vocabulary holds at most the ``max_terms`` it was fitted with, which bounds what is sent to
    every task. Applying it moves no text between tasks.
    """

    vocabulary: DataFrame
    documents: int
    counter: CountVectorizerModel
    idf: DenseVector
    terms: Callable[[str], Column] = words

    def vectors(self, df: DataFrame, text: str, out: str = "features",
                counts: str | None = None) -> DataFrame:
        """Add the weights tf * idf, scaled to length 1, as a sparse vector, and under the name
        ``counts`` the plain tf."""
        tf = counts or "__tf"
        counter = self.counter.copy().setInputCol("__terms").setOutputCol(tf)
        product = ElementwiseProduct(scalingVec=self.idf, inputCol=tf, outputCol="__weighted")
        unit = Normalizer(p=2.0, inputCol="__weighted", outputCol=out)
        tokens = df.withColumn("__terms", self.terms(text))
        return (unit.transform(product.transform(counter.transform(tokens)))
                .drop("__terms", "__weighted", "__tf"))

    def weights(self, df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
        """The same in long form: ``(*keep, term, tf, weight)``."""
        both = self.vectors(df.select(*keep, text), text, "__unit", "__counts")
        pairs = F.arrays_zip(
            F.unwrap_udt("__unit")["indices"].alias("index"),
            F.unwrap_udt("__counts")["values"].alias("tf"),
            F.unwrap_udt("__unit")["values"].alias("weight"))
        terms = self.vocabulary.select("index", "term")
        return (both.select(*keep, F.explode(pairs).alias("e"))
                .select(*keep, F.col("e.index").alias("index"), F.col("e.tf").cast("long").alias("tf"),
                        F.col("e.weight").alias("weight"))
                .join(terms, "index").select(*keep, "term", "tf", "weight"))


def _document_share(limit: float | int, documents: int) -> float:
    return limit if isinstance(limit, int) else limit * documents


def fit_tfidf(df: DataFrame, text: str, min_df: float | int = 0.0001, max_df: float | int = 0.8,
              max_terms: int = 100_000, terms: Callable[[str], Column] = words) -> Tfidf:
    """Count terms and the texts they occur in, keep those within the limits (shares of the texts or
    whole numbers), the most frequent first, and weigh them by ln((1 + texts) / (1 + df)) + 1.

    A share as the lower limit bounds the terms that are left whatever the number of texts: each is in
    that share of them, so there are at most (mean distinct terms of a text) / share.

    ``terms`` turns a text column into an array of terms: words, or stems of them.
    """
    tokens = df.select(terms(text).alias("__terms"))
    documents = df.count()
    # a term's occurrences and its texts are counted in one shuffle
    once = tokens.select(F.explode(F.array_distinct("__terms")).alias("term"), F.lit(1).alias("d"), F.lit(0).alias("n"))
    every = tokens.select(F.explode("__terms").alias("term"), F.lit(0).alias("d"), F.lit(1).alias("n"))
    counted = once.unionByName(every).groupBy("term").agg(F.sum("d").alias("df"), F.sum("n").alias("total"))
    # stored, as finding the ranges of the places reads it once more
    kept = checkpointed(counted.filter((F.col("df") >= _document_share(min_df, documents))
                                       & (F.col("df") <= _document_share(max_df, documents))))
    idf = F.log(F.lit(1.0 + documents) / (1 + F.col("df"))) + 1
    # places by range partitions: no task merges the candidates of all others
    placed = with_row_number(kept.withColumn("__rare_last", -F.col("total")), ["__rare_last", "term"], "__place")
    vocabulary = checkpointed(placed.filter(F.col("__place") <= max_terms).select(
        (F.col("__place") - 1).cast("int").alias("index"), "term", "df", "total", idf.alias("idf")))
    chosen = vocabulary.select("index", "term", "idf").orderBy("index").toPandas()
    if chosen.empty:
        raise ValueError("no term is within the limits")
    counter = CountVectorizerModel.from_vocabulary(chosen["term"].tolist(), inputCol="term", outputCol="tf")
    return Tfidf(vocabulary, documents, counter,
                 Vectors.dense(chosen["idf"].to_numpy()), terms)
