"""Registered queries of the subpackage and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from boutline.llm import align, decontam, lmscore, mixing, packing, periods, quality, secrets, sharding, simhash, tokenfile, topk, warc
from boutline.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SHARDS = 24


@query("op1_reshard")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents moved from shards by source (uneven) to 24 shards of equal bytes, read back from the new files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(SHARDS))
    plan = sharding.reshard(docs.select("doc_id", "text", old.cast("int").alias("old_shard")), F.col("old_shard"), SHARDS, SHARDS)
    files = sharding.rewrite(plan, only=list(range(SHARDS)))
    return files.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by pattern and by linked parts."""
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(secrets.BASE)],
        F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"),
    )


_DIGIT = "instr('0123456789abcdef', substr(x, CAST({0} AS BIGINT), 1)) - 1"
_BASE32 = (
    "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + "
    f"(((({_DIGIT.format('i * 5 // 4 + 1')}) * 16 + {_DIGIT.format('i * 5 // 4 + 2')}) >> (3 - CAST(i * 5 % 4 AS INTEGER))) & 31), 1)), 'string_agg', '')"
)


@query(
    "op6_warc",
    f"""WITH d AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY x, payload_bytes) AS head FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
   CASE WHEN page_id <> head THEN head END AS refers_to, url FROM h""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    records, _ = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query("op7_tokenfile")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written to range-coded files and read back."""
    return tokenfile.read_files(tokenfile.write_files(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed 5:2:1 to 150 % of the corpus."""
    return mixing.mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op2_topk",
    """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.t, c.t), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one by integer inner product."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_numbers("embedding").alias("terms"))
    return topk.top_k(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    stats = out.columns[-2]
    return out.select(
        "doc_id", *[quality.stat(stats, c).alias(c) for c in quality.BASE], quality.base_failed(stats).alias("base_failed"), "kept",
        *[quality.stat(stats, c).alias(c) for c in quality.MORE],
    )


@query("op9_lmscore")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under an interpolated bigram model of the training documents."""
    return lmscore.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of at most 1024 tokens."""
    return packing.packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op11_decontam",
    f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS t FROM i),
s AS (SELECT DISTINCT k FROM i),
x AS (SELECT r, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: {{'p': p, 't': array_to_string(w[p:p + k - 1], ' ')}})) AS u FROM d, s),
h AS (SELECT x.r, x.k, x.u.p AS p, g.item_id FROM x JOIN g ON x.k = g.k AND x.u.t = g.t),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, k, p FROM h)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
   n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside passages of ten words that a benchmark item holds, and those items."""
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@query("op12_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens in two tokenizers, and how common the links are in the corpus."""
    out = align.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), spell=False).drop("text")
    name = out.columns[-1]
    out = align.with_support(out, name)
    of = lambda n: F.col(name)[n].alias(n)
    return out.select("doc_id", *map(of, ("n_a", "n_b", "n_groups", "n_links")), *out.columns[-2:], of("groups_sha256"))


@query("op13_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, every tenth of which is made periodic first."""
    out = periods.with_runs(periods.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col(out.columns[-1])["runs"]
    best = out.select("doc_id", out.columns[-1], F.explode(F.array(periods.strongest(runs))).alias("best"))
    top = lambda n: F.col("best")[n].alias(n)
    return best.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), top("start"), top("length"), top("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(periods.spelled(runs), 256).alias("runs_sha256"), F.sha2(F.col(out.columns[-1])["collapsed"], 256).alias("collapsed_sha256"),
    )


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
