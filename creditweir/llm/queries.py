"""The registered queries of this subpackage and their SQL."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir.llm import centroids, conversations, decontamination, language, licences, near_copies, packing, pages, quality, repeats, shards
from creditweir.llm import token_files, urls
from creditweir.llm.scratch import scratch
from creditweir.llm.tokens import default_vocabulary
from creditweir.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, token_files.token_folder(spark), default_vocabulary(), end_id=2)
    return token_files.read_documents(manifest)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/shards-{uuid4().hex}"
    with scratch():
        placed = shards.shard(_table(spark, sf_dir, "documents"), limit=shards.LIMIT)
        shards.write(placed, folder)
    return spark.read.parquet(folder).select("row.doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows", "oversized")


OP2_SQL = f"""
WITH RECURSIVE rows_ AS MATERIALIZED (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15)) AS BIGINT) AS h
  FROM documents
),
levels AS MATERIALIZED (
  SELECT CAST(d AS INTEGER) AS depth, h >> (60 - d) AS prefix, sum(n_bytes) AS bytes, count(*) AS n
  FROM rows_, generate_series(0, 60) AS g(d) GROUP BY ALL
),
fits AS (
  SELECT r.doc_id, r.n_bytes, r.h, min(l.depth) AS depth
  FROM rows_ r JOIN levels l ON l.prefix = r.h >> (60 - l.depth)
  WHERE l.bytes <= {shards.LIMIT} OR l.depth = 60 GROUP BY ALL
)
SELECT f.doc_id, f.n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE right(bin(f.h + (1::BIGINT << 60))[2:], 60)[1:f.depth] END AS shard,
  f.depth, CAST(l.bytes AS BIGINT) AS shard_bytes, l.n AS shard_rows, l.bytes > {shards.LIMIT} AS oversized
FROM fits f JOIN levels l ON l.depth = f.depth AND l.prefix = f.h >> (60 - f.depth)
"""


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return quality.judge(_table(spark, sf_dir, "documents")).select(columns)


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.in_fold(1)))
    judged = language.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", language.in_fold(1).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return decontamination.digest(found)


#: Words of a text as the search takes them, lower-cased A to Z only.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
),
grams AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
    FROM d, (SELECT DISTINCT len(g) AS n FROM windows) WHERE len(w) >= n
  )
),
hits AS MATERIALIZED (SELECT doc_id, i, n, item FROM grams JOIN windows USING (g)),
spots AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
"""


#: (verdict, host, path) of the listed rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")
    )
    judged = urls.judge(_table(spark, sf_dir, "pages"), marks, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _sql_tokens(text: str, kind: str) -> str:
    return f"list_transform(regexp_extract_all(translate({text}, '{urls.UPPER}', '{urls.LOWER}'), '[a-z][a-z-]+'), lambda t: '{kind}' || t)"


_FITS = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {{value_{i}}}"
    for i, (_, host, path) in enumerate(sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])))
)
_LONGEST = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
OP9_SQL = f"""
WITH split AS MATERIALIZED (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, substr(rest, 1 + strlen(regexp_extract(rest, '^[^?#]*'))) AS tail
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
),
pages_ AS MATERIALIZED (
  SELECT page_id, host, path, CASE {_FITS.format(**{f"value_{i}": f"'{h}{p}'" for i, (_, h, p) in enumerate(_LONGEST)})} END AS rule,
    CASE {_FITS.format(**{f"value_{i}": f"'{v}'" for i, (v, _, _) in enumerate(_LONGEST)})} END AS listed,
    list_sort(list_distinct({_sql_tokens("host", "h:")} || {_sql_tokens("path", "p:")} || {_sql_tokens("tail", "q:")})) AS tokens
  FROM split
),
marked AS MATERIALIZED (
  SELECT tokens, toxic = 1 OR quality = 0 AS bad FROM pages_ JOIN labels ON page_id = doc_id
  WHERE (toxic = 1 OR quality = 0) IS NOT NULL
),
size_ AS (SELECT count(*) AS total, count(*) FILTER (bad) AS bad FROM marked),
subsets AS (
  SELECT bad, list_filter(tokens, lambda t, i: (m >> (i - 1)) & 1 = 1) AS items
  FROM (SELECT bad, tokens, unnest(generate_series(1, (1 << len(tokens)) - 1)) AS m FROM marked)
),
rules AS MATERIALIZED (
  SELECT items, count(*) AS n_all, count(*) FILTER (subsets.bad) AS n_bad, any_value(size_.total) AS total, any_value(size_.bad) AS bad
  FROM subsets, size_ GROUP BY items
  HAVING n_bad >= greatest({urls.MIN_COUNT}, ceil(any_value(size_.total) * {urls.MIN_SUPPORT}))
    AND n_bad >= {urls.MIN_CONFIDENCE} * n_all AND n_bad * any_value(size_.total) > any_value(size_.bad) * n_all
)
SELECT page_id, host, path, rule,
  coalesce(listed, CASE WHEN EXISTS (SELECT 1 FROM rules WHERE list_has_all(pages_.tokens, rules.items)) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages_
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = packing.pieces(_table(spark, sf_dir, "documents"), default_vocabulary(), end_id=0)
    packed = packing.pack(table)
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long"), F.col("offset").cast("long")
    )


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove(_table(spark, sf_dir, "documents"), length=200))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damage(turns), turns)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def _sql_round(number: int) -> str:
    """Assignment to the centroids of a round, and the centroids of the next."""
    return f"""
a{number} AS MATERIALIZED (
  SELECT vec_id, v, c, d FROM (
    SELECT r, vec_id, v, c, list_sum(list_transform(list_zip(v, p), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM vectors, c{number}
  ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
),
c{number + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.p, o.p) AS p FROM c{number} o LEFT JOIN (
    SELECT c, list(m ORDER BY i) AS p FROM (
      SELECT c, i, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
      FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{number}) GROUP BY c, i
    ) GROUP BY c
  ) n USING (c)
)"""


#: Sums divide as doubles: exact floors while a cluster's sums stay far below 2^53.
OP13_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {centroids.DIMENSIONS}
),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS c, v AS p
  FROM vectors QUALIFY c < {centroids.CLUSTERS}
),{",".join(_sql_round(i) for i in range(centroids.ROUNDS + 1))}
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN (SELECT c, p FROM c{centroids.ROUNDS}) USING (c)
"""


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_sharding": op2_sharding,
    "op3_main_text": op3_main_text,
    "op4_quality": op4_quality,
    "op5_near_copies": op5_near_copies,
    "op6_licences": op6_licences,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_centroids": op13_centroids,
}
ORACLES: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op13_centroids": OP13_SQL,
}
