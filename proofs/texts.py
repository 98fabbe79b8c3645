"""Text cleaning, words and stems over the whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofs.registry import Tables, proof, rounded
from shoplore.functions import text as cleaners
from shoplore.operators import words as counting
from shoplore.plans.reviews import labelled_reviews


def _replace(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


LINK = "https?://[!$-_a-z]+"
DATE = r"([0-2][0-9]|3[01])(/|\.)(0[0-9]|1[0-2])(/|\.)\p{Nd}{2,4}"
MONEY = r"R?\$[ ]*\p{Nd}+(,|\.)\p{Nd}+"


def clean_sql(text: str) -> str:
    for pattern, to in ((r"[\n\r]", " "), (LINK, " link "), (DATE, " date "), (MONEY, " money "),
                        ("[0-9]+", " number "), (r"[^\p{L}\p{N}_]", " "), (" +", " "), (" +$", "")):
        text = _replace(text, pattern, to)
    return text


@proof(f"""
SELECT page_id, {_replace("('see ' || url || ' (or ' || url || ' )')", LINK, ' link ')} AS text FROM pages
""")
def mask_links(t: Tables):
    sentence = F.concat(F.lit("see "), F.col("url"), F.lit(" (or "), F.col("url"), F.lit(" )"))
    return t.pages.select("page_id", cleaners.mask_links(sentence).alias("text"))


@proof(f"SELECT doc_id, {_replace(_replace('text', DATE, ' date '), MONEY, ' money ')} AS text FROM documents")
def mask_dates_money(t: Tables):
    return t.documents.select("doc_id", cleaners.mask_money(cleaners.mask_dates("text")).alias("text"))


@proof(f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def clean_text(t: Tables):
    return t.documents.select("doc_id", cleaners.clean_text("text").alias("text"))


@proof(r"""
SELECT doc_id, regexp_replace(text || ' :) ok :(( :', ':[()]+', '', 'g') AS text FROM documents
""")
def strip_emoticons(t: Tables):
    smiling = F.concat(F.col("text"), F.lit(" :) ok :(( :"))
    return t.documents.select("doc_id", cleaners.strip_emoticons(smiling).alias("text"))


@proof("""
SELECT doc_id, CASE WHEN 1 + doc_id % 5 <= 2 THEN 'Negative' ELSE 'Positive' END AS sentiment
FROM documents WHERE lang <> 'de'
""")
def sentiment_label(t: Tables):
    reviews = t.documents.select(
        "doc_id", (1 + F.col("doc_id") % 5).alias("score"),
        F.when(F.col("lang") == "de", "Not Defined").otherwise(F.col("text")).alias("message"))
    return labelled_reviews(reviews, "score", "message").select("doc_id", "sentiment")


TOKENS_SQL = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))"


@proof(f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {TOKENS_SQL} AS word FROM documents) GROUP BY 1, 2")
def token_counts(t: Tables):
    return counting.token_counts(t.documents, "doc_id", "text")


STOP_WORDS = ["the", "and", "that", "with", "les", "que", "des", "und", "die"]

WORDS_SQL = f"""
counted AS (SELECT word, count(*) AS n FROM (SELECT {TOKENS_SQL} AS word FROM documents)
            WHERE word NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})
            AND NOT regexp_full_match(word, '[0-9]+') GROUP BY 1),
folded AS (SELECT coalesce(s.word, p.word) AS word, CAST(sum(p.n) AS BIGINT) AS n
           FROM counted p LEFT JOIN counted s
           ON p.word = s.word || 's' AND NOT ends_with(p.word, 'ss') GROUP BY 1)
"""


@proof(f"""
WITH {WORDS_SQL} SELECT word, n, round(n / (SELECT max(n) FROM folded)::DOUBLE, 6) AS relative FROM folded
""")
def word_freq(t: Tables):
    counts = counting.word_counts(t.documents, "text", STOP_WORDS, keep_numbers=False, fold_plurals=True)
    return rounded(counting.with_relative_frequency(counts), "relative")


@proof(f"""
WITH counted AS (SELECT word, count(*) AS n FROM (SELECT {TOKENS_SQL} AS word FROM documents) GROUP BY 1)
SELECT word, n, round(n / (SELECT max(n) FROM counted)::DOUBLE, 6) AS relative
FROM counted ORDER BY n DESC, word LIMIT 20
""")
def word_freq_top20(t: Tables):
    return rounded(counting.top_words(counting.word_counts(t.documents, "text")), "relative")


@proof(f"""
WITH counted AS (SELECT quality, word, count(*) AS n FROM
 (SELECT quality, {TOKENS_SQL} AS word FROM documents JOIN labels USING (doc_id)) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, word) AS place,
           max(n) OVER (PARTITION BY quality) AS most FROM counted)
SELECT quality, word, n, round(n / most::DOUBLE, 6) AS relative FROM ranked WHERE place <= 20
""")
def word_freq_by_label(t: Tables):
    labelled = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id")
    top = counting.top_words(counting.word_counts(labelled, "text", by=["quality"]), by=["quality"])
    return rounded(top, "relative")


@proof(f"""
WITH counted AS (SELECT word, count(*) AS n FROM (SELECT {TOKENS_SQL} AS word FROM documents) GROUP BY 1)
SELECT regexp_replace(word, '(mente|tion|s)$', '') AS stem, count(*) AS words, CAST(sum(n) AS BIGINT) AS n
FROM counted GROUP BY 1
""")
def stem_vocabulary(t: Tables):
    counts = counting.word_counts(t.documents, "text")
    return counting.stem_vocabulary(counts, [counting.Suffix(1, ending) for ending in ("mente", "tion", "s")])


@proof(f"""
WITH counted AS (SELECT word, count(*) AS n FROM (SELECT {TOKENS_SQL} AS word FROM documents) GROUP BY 1),
one AS (SELECT n, CASE WHEN ends_with(word, 'ies') AND length(word) >= 5 THEN left(word, length(word) - 3) || 'y'
  WHEN ends_with(word, 'es') AND length(word) >= 5 THEN left(word, length(word) - 2)
  WHEN ends_with(word, 's') AND length(word) >= 4 THEN left(word, length(word) - 1) ELSE word END AS w FROM counted),
two AS (SELECT n, CASE WHEN ends_with(w, 'mente') AND length(w) >= 8 THEN left(w, length(w) - 5)
  WHEN ends_with(w, 'ción') AND length(w) >= 7 THEN left(w, length(w) - 4) || 'r'
  WHEN ends_with(w, 'tion') AND length(w) >= 7 THEN left(w, length(w) - 4) || 't' ELSE w END AS w FROM one),
three AS (SELECT n, CASE WHEN regexp_matches(w, '^.{{2,}}[aeo]$') THEN left(w, length(w) - 1) ELSE w END AS stem FROM two)
SELECT stem, count(*) AS words, CAST(sum(n) AS BIGINT) AS n FROM three GROUP BY 1
""")
def stem_steps(t: Tables):
    """Plurals, then endings of kinds of words, then a last vowel."""
    rules = [counting.Suffix(1, "ies", "y", 2), counting.Suffix(1, "es", "", 3), counting.Suffix(1, "s", "", 3),
             counting.Suffix(2, "mente", "", 3), counting.Suffix(2, "ción", "r", 3), counting.Suffix(2, "tion", "t", 3),
             *[counting.Suffix(3, vowel, "", 2) for vowel in "aeo"]]
    return counting.stem_vocabulary(counting.word_counts(t.documents, "text"), rules)


_SUBSETS = {"good": "quality = 1", "bad": "quality = 0", "toxic": "toxic = 1"}


@proof(f"""
WITH labelled AS (SELECT text, quality, toxic FROM documents JOIN labels USING (doc_id)),
every AS ({" UNION ALL ".join(f"SELECT '{name}' AS subset, text FROM labelled WHERE {rule}" for name, rule in _SUBSETS.items())}),
counted AS (SELECT subset, word, count(*) AS n FROM (SELECT subset, {TOKENS_SQL} AS word FROM every) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY n DESC, word) AS place,
           max(n) OVER (PARTITION BY subset) AS most FROM counted)
SELECT subset, word, n, round(n / most::DOUBLE, 6) AS relative FROM ranked WHERE place <= 20
""")
def word_freq_subsets(t: Tables):
    """Subsets that overlap: a toxic text is good or bad as well."""
    labelled = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    counts = counting.subset_word_counts(labelled, "text", {n: F.expr(rule) for n, rule in _SUBSETS.items()})
    return rounded(counting.top_words_of_subsets(counts, list(_SUBSETS)), "relative")
