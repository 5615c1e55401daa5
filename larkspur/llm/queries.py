"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.ann import build_index, search
from larkspur.llm.lexical import TERM, rank_documents
from larkspur.llm.licenses import scan_licenses
from larkspur.llm.linededup import DIVISOR, LEAST_LINES, remove_repeated_chunks
from larkspur.llm.mixing import mix
from larkspur.llm.neardup import near_duplicates
from larkspur.llm.packing import pack_documents
from larkspur.llm.quality import assess_quality
from larkspur.llm.sharding import assign_shards
from larkspur.llm.substring import remove_repeated
from larkspur.llm.toxicity import score_toxicity
from larkspur.llm.urlfilter import PATH, host_of, match_captures
from larkspur.llm.whitening import whiten
from larkspur.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Entropy of the mixture's weights, as a share of the largest possible.
MIX_ENTROPY = 0.95


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_word=True)
    return packed.withColumnRenamed("id", "doc_id")


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = assess_quality(_table(spark, sf_dir, "documents"))
    return judged.withColumnRenamed("id", "doc_id")


@_query
def op3_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books = build_index(_table(spark, sf_dir, "embeddings"))
    found = search(index, books, F.col("id") % 20 == 0, k=20)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("id").cast("long").alias("vec_id"), "score")


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def _captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch time, which the table lacks: a day of 2024 that follows from page_id."""
    return pages.select("page_id", "url", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(page_id * 7919 % 365 as int))").alias("fetched_at"))


def _list_events(pages: DataFrame) -> DataFrame:
    """Dated list entries that follow from the hosts of pages: a host in two is listed, some with a path, some for a while or twice."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", PATH, 1).alias("path")).filter("host <> ''")
    hosts = hosts.groupBy("host").agg(F.min(F.split_part("path", F.lit("/"), F.lit(2))).alias("top"))
    hosts = hosts.withColumn("m", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long")).filter("m % 2 = 0")
    key = F.when((F.expr("m % 5 = 1")) & (F.col("top") != ""), F.concat("host", F.lit("/"), "top")).otherwise(F.col("host"))
    day = lambda e: F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(cast({e} as int))")
    event = lambda action, e, when="true": F.when(F.expr(when), F.struct(F.lit(action).alias("action"), day(e).alias("at")))
    events = F.array_compact(F.array(event("add", "m % 300"), event("remove", "m % 300 + 30", "m % 3 = 0"), event("add", "m % 300 + 50", "m % 9 = 0")))
    return hosts.select(F.concat(F.lit("list"), F.expr("m % 4").cast("string")).alias("list"), key.alias("key"), F.explode(events).alias("e")).select("list", "key", "e.*")


@_query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = match_captures(_captures(pages), _list_events(pages))
    return judged.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "matched_entries", F.array_join("matched_lists", ",").alias("matched_lists"), "blocked")


ORACLES["op5_url_filters"] = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id * 7919 % 365)::INT) AS moment,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT host, min(split_part(path, '/', 2)) AS top, ('0x' || substr(md5(host), 1, 7))::BIGINT AS m FROM captures WHERE host <> '' GROUP BY host),
listed AS (SELECT *, 'list' || (m % 4) AS list, CASE WHEN m % 5 = 1 AND top <> '' THEN host || '/' || top ELSE host END AS key FROM hosts WHERE m % 2 = 0),
events AS (
  SELECT list, key, 'add' AS action, TIMESTAMP '2024-01-01' + to_days((m % 300)::INT) AS moment FROM listed
  UNION ALL SELECT list, key, 'remove', TIMESTAMP '2024-01-01' + to_days((m % 300 + 30)::INT) FROM listed WHERE m % 3 = 0
  UNION ALL SELECT list, key, 'add', TIMESTAMP '2024-01-01' + to_days((m % 300 + 50)::INT) FROM listed WHERE m % 9 = 0),
labels AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda s: s <> '') AS p FROM captures),
keyed AS (
  SELECT page_id, url, moment, array_to_string(l[i:], '.') AS key FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM labels WHERE host <> '')
  UNION ALL SELECT page_id, url, moment, host || '/' || array_to_string(p[:i], '/') FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM labels WHERE host <> '' AND len(p) > 0)),
latest AS (SELECT k.page_id, k.url, k.moment, e.list, e.key, arg_max(e.action, e.moment) AS action FROM keyed k JOIN events e ON e.key = k.key AND e.moment <= k.moment GROUP BY ALL),
found AS (SELECT page_id, url, moment, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM latest WHERE action = 'add' GROUP BY ALL)
SELECT c.page_id, c.url, strftime(c.moment, '%Y-%m-%d') AS fetched_on, coalesce(n, 0)::BIGINT AS matched_entries, coalesce(lists, '') AS matched_lists, n IS NOT NULL AS blocked
FROM captures c LEFT JOIN found f ON f.page_id = c.page_id AND f.url = c.url AND f.moment = c.moment
"""


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = assign_shards(_table(spark, sf_dir, "documents"), shards=16)
    return assigned.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.withColumnRenamed("id", "doc_id")


_LINES = f"""
WITH docs AS (SELECT DISTINCT doc_id, text, md5(text) AS key, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, key, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines),
marked AS (SELECT *, i = n OR (coalesce(lag(h) OVER (PARTITION BY doc_id, key ORDER BY i), 0) * 31 + h) % {DIVISOR} = 0 AS ends FROM hashed),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM marked),
chunks AS (SELECT doc_id, key, chunk, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, key, chunk) AS place FROM chunks),
judged AS (SELECT *, n_lines >= {LEAST_LINES} AND place > 1 AS gone FROM placed),
done AS (SELECT doc_id, key, coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS kept, coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS n_removed FROM judged GROUP BY ALL)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN done ON d.doc_id IS NOT DISTINCT FROM done.doc_id AND md5(d.text) = done.key
"""


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_chunks(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("lines_removed").cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op8_line_dedup"] = _LINES


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated(_table(spark, sf_dir, "documents"), window=35, minimiser=8)
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query
def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = mix(_table(spark, sf_dir, "documents"), entropy=MIX_ENTROPY)
    return read.withColumnRenamed("id", "doc_id")


ORACLES["op10_temperature_mixing"] = f"""
WITH RECURSIVE
rows AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(text, '')), 1, 12))::BIGINT AS chk, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
shares AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS n, sum(tokens) / (SELECT sum(tokens) FROM rows)::DOUBLE AS share FROM rows GROUP BY source HAVING sum(tokens) > 0),
halves AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 8.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN met THEN lo ELSE (lo + hi) / 2 END, CASE WHEN met THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT h.step, h.lo, h.hi, (SELECT ln(sum(pow(share, (h.lo + h.hi) / 2))) - (h.lo + h.hi) / 2 * sum(pow(share, (h.lo + h.hi) / 2) * ln(share)) / sum(pow(share, (h.lo + h.hi) / 2)) <= {MIX_ENTROPY} * ln(count(*)) FROM shares) AS met FROM halves h WHERE step < 40)),
alpha AS (SELECT CASE WHEN (SELECT count(*) FROM shares) < 2 THEN 1.0 ELSE round(hi, 6) END AS a FROM halves WHERE step = 40),
plan AS (SELECT source, tokens AS all_tokens, round(pow(share, a) / (SELECT sum(pow(share, a)) FROM shares, alpha) * (SELECT sum(tokens) FROM shares)::DOUBLE)::BIGINT AS quota, ceil(n / 256.0)::BIGINT AS blocks FROM shares, alpha),
placed AS (
  SELECT r.*, quota // all_tokens AS whole, quota % all_tokens AS rest,
         floor(('0x' || substr(md5('17|' || coalesce(r.doc_id::VARCHAR, '') || '|' || chk), 1, 12))::BIGINT / 281474976710656.0 * blocks)::BIGINT AS block
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
keyed AS (
  SELECT *, ('0x' || substr(md5('17|' || (whole + 1) || '|' || coalesce(source, '') || '|' || block), 1, 12))::BIGINT AS bk,
         ('0x' || substr(md5('17|' || (whole + 1) || '|' || coalesce(doc_id::VARCHAR, '') || '|' || chk), 1, 12))::BIGINT AS rk FROM placed),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY bk, block, rk, doc_id, tokens, chk) AS upto FROM keyed),
counted AS (SELECT *, whole + (rest > 0 AND upto <= rest)::INT AS readings FROM summed),
read AS (SELECT doc_id, source, tokens, chk, block, unnest(generate_series(1, readings)) AS epoch FROM counted WHERE readings > 0)
SELECT doc_id, source, tokens, epoch::INT AS epoch,
       ('0x' || substr(md5('17|' || epoch || '|' || coalesce(source, '') || '|' || block), 1, 12))::BIGINT AS block_key,
       ('0x' || substr(md5('17|' || epoch || '|' || coalesce(doc_id::VARCHAR, '') || '|' || chk), 1, 12))::BIGINT AS row_key
FROM read
"""


@_query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
ORACLES["op11_ranked_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM docs),
total AS (SELECT count(*) FILTER (n > 0) AS big_n, sum(n)::BIGINT AS big_l FROM sized),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
found AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM found, total GROUP BY term, big_n),
parts AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) AS part FROM found JOIN weighed USING (term) JOIN sized USING (row), total),
scored AS (SELECT item_id, row, doc_id, sum(part * repeats)::BIGINT AS score FROM parts JOIN asked USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@_query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    own, more = F.col("base.label"), F.col("found.label")
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    starts = F.col("base.first_word")
    # a base phrase stands as it is; a template has its share
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0)))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, more)).alias("labels"), score.alias("score"), "found")


@_query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whiten(_table(spark, sf_dir, "embeddings"))
    n, shares = (model.n, [float(v / model.trace) for v in model.values]) if model else (0, [])
    each = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    # deviations beyond a long are null here; the operator has 38 digits
    return each.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
