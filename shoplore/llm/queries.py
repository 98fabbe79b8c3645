"""One query per operator, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplore.llm.bpe import bpe_digest, load_tokenizer
from shoplore.llm.language import language_predictions
from shoplore.llm.pu_quality import quality_scores
from shoplore.llm.quality_rules import BOILERPLATE, quality_rules
from shoplore.llm.quotes import chat_line, reply_ordered
from shoplore.llm.registry import QUERIES, query
from shoplore.llm import scan_queries  # noqa: F401  (registers its queries)
from shoplore.llm.shards import shuffle_into_shards
from shoplore.llm.simhash import fingerprint_hex, simhash_components
from shoplore.llm.tiling import leaked_items
from shoplore.llm.toxicity import toxicity_scores
from shoplore.llm.urls import Rule, url_verdicts

__all__ = ["QUERIES"]

_BLANKS = r"[\x20\x09-\x0D]"
_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)

OP2_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANKS}'), lambda x: x <> '') AS w FROM docs),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs),
counted AS (
  SELECT *, len(list_filter(regexp_split_to_array(line, '{_BLANKS}'), lambda x: x <> '')) AS n,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    length(regexp_replace(line, '[^|>»›·•]', '', 'g')) AS separators,
    len(regexp_extract_all(line, '[!?]{{2,}}')) AS shouts FROM lines),
judged AS (
  SELECT *, (100 * symbols > 30 * n OR (separators >= 3 AND 100 * separators > 20 * n) OR 100 * shouts > 20 * n
    OR (n <= 4 AND NOT regexp_matches(line, '[.!?…:;,"''”’»)\]]{_BLANKS}*$'))
    OR (n <= 25 AND ({_PHRASES}))) AS fails FROM counted WHERE n > 0),
by_line AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines,
    coalesce(sum(n) FILTER (WHERE fails), 0) AS n_lost_words, count(*) FILTER (WHERE fails) AS n_lost_lines
  FROM judged GROUP BY rid),
windows AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (
    SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
final AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{_BLANKS}', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words,
    coalesce(n_lost_lines, 0) AS n_lost_lines
  FROM words LEFT JOIN by_line USING (rid) LEFT JOIN covered USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lost_words AS BIGINT) AS n_lost_words,
  CAST(n_lost_lines AS BIGINT) AS n_lost_lines,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (100 * n_lost_words > 70 * n_words) AS kept
FROM final
"""


@query(OP2_SQL)
def op2_quality_rules(table):
    return quality_rules(table("documents"))


@query()
def op8_bpe(table):
    import public_tokenizers

    documents = table("documents")
    tokenizer = load_tokenizer(documents.sparkSession, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe_digest(documents, tokenizer)


@query()
def op9_simhash(table):
    found = simhash_components(table("documents"))
    return found.select("doc_id", fingerprint_hex("fingerprint").alias("fingerprint"),
                        F.col("component_id").cast("long").alias("component_id"))


@query()
def op5_language(table):
    return language_predictions(table("documents"))


@query()
def op10_shards(table):
    text = F.coalesce("text", F.lit(""))
    measured = table("documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shuffle_into_shards(measured).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op1_quality(table):
    return quality_scores(table("documents"), table("labels"))


@query()
def op6_toxicity(table):
    return toxicity_scores(table("documents"), table("labels"))


@query()
def op3_decontamination(table):
    return leaked_items(table("documents"), table("benchmark"))


#: The rules of the page filter, as the contract of the query fixes them.
URL_RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
             Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

_HOST_SQL = ("translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_PATH_SQL = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _rules_sql(host: str, path: str, action: bool) -> str:
    cases = " ".join(
        f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') "
        f"THEN '{r.action if action else r.host + r.path}'"
        for r in sorted(URL_RULES, key=lambda r: -len(r.host + r.path)))
    return f"CASE {cases} END"


_NODE_SQL = (f"CASE WHEN {_HOST_SQL} <> '' THEN {_HOST_SQL} || regexp_replace({_PATH_SQL}, '/+$', '') || regexp_replace(array_to_string("
             "list_filter(regexp_split_to_array(regexp_extract({u}, '(?s)^[^#]*?\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT "
             "regexp_matches(p, '(?i)^(utm_[^=&]*|ref|fbclid|gclid)=')), '&'), '^(.)', '?\\1') END")
OP4_SQL = rf"""
WITH RECURSIVE links AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*[''"]?([^''">\s]+)', 1))
  )) AS target FROM pages),
edges AS (SELECT {_NODE_SQL.format(u='url')} AS a, {_NODE_SQL.format(u='target')} AS b FROM links WHERE contains(target, '://')),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
judged AS (SELECT page_id, url, {_HOST_SQL.format(u="coalesce(url, '')")} AS host, {_PATH_SQL.format(u="coalesce(url, '')")} AS path,
  {_NODE_SQL.format(u="coalesce(url, '')")} AS node FROM pages),
ruled AS (SELECT *, {_rules_sql('host', 'path', False)} AS rule, {_rules_sql('host', 'path', True)} AS action FROM judged),
told AS (SELECT node, action FROM ruled WHERE action IS NOT NULL UNION
  SELECT {_NODE_SQL.format(u='target')}, {_rules_sql(_HOST_SQL.format(u='target'), _PATH_SQL.format(u='target'), True)} FROM links),
blocked AS (SELECT r.a AS node FROM reach r JOIN told t ON t.node = r.b GROUP BY r.a
  HAVING bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), false))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


@query(OP4_SQL)
def op4_urls(table):
    return url_verdicts(table("pages").select("page_id", "url", "html"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) - 1 AS position,
  CAST(NULL AS BIGINT) AS reply_to, turn AS thread, CAST(0 AS BIGINT) AS depth, CAST(0 AS INTEGER) AS quote_levels,
  CAST(0 AS INTEGER) AS quoted_lines, text,
  '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS chat
FROM conversations
"""


@query(OP7_SQL)  # as long as no given message quotes; the next query has quotes
def op7_quotes(table):
    return reply_ordered(table("conversations")).withColumn("chat", chat_line("role", "text"))


QUOTED_REPLIES_SQL = r"""
WITH ordered AS (
  SELECT conv_id, turn, role, text, lag(text) OVER w AS one, lag(text, 2) OVER w AS two, lag(turn) OVER w AS before,
    row_number() OVER w - 1 AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, n AS position, before AS reply_to, first_value(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS thread,
  n AS depth, CAST(CASE WHEN two IS NOT NULL THEN 2 WHEN one IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS quote_levels,
  CAST(coalesce(len(string_split(one, chr(10))), 0) + coalesce(len(string_split(two, chr(10))), 0) AS INTEGER) AS quoted_lines,
  text FROM ordered
"""


@query(QUOTED_REPLIES_SQL)
def quoted_replies(table):
    """Every given message quotes the one before it, which quotes the one before that, as mail does."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    mail = table("conversations").withColumns({"one": F.lag("text").over(order), "two": F.lag("text", 2).over(order)})

    def quoted(column: str, marks: str):
        return F.concat(F.lit(marks), F.array_join(F.split(column, "\n"), "\n" + marks), F.lit("\n"))

    body = F.concat(F.when(F.col("one").isNotNull(), "On Monday somebody wrote:\n").otherwise(""),
                    F.coalesce(quoted("two", ">> "), F.lit("")), F.coalesce(quoted("one", "> "), F.lit("")), F.col("text"))
    return reply_ordered(mail.withColumn("text", body))
