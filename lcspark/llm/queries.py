"""The registered queries of the training-data operators: each applies its
operator to its whole table and derives the columns that identify the
result.  ``QUERIES`` and ``ORACLES`` are added by ``__spark_entry__``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.llm import (
    bpe,
    centroids,
    chat,
    exactdedup,
    fingerprints,
    langid,
    neardup,
    packing,
    periodic,
    pii,
    sharding,
    toxicity,
    urlfilter,
)
from lcspark.llm.common import let, table, words

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def word_tokenizer() -> str:
    """The definition of the tokenizer whose ids are packed."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@register("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = fingerprints.with_next(docs)
    chars = F.length("text")
    tail = F.floor(chars / 2).cast("int")
    edited = pairs.withColumn("n_chars", chars.cast("bigint")).withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), chars - tail), F.substr("next_text", F.lit(1), tail)))
    sketched = edited.withColumn("edited_sketch", fingerprints.sketch(F.col("edited")))
    s, e, n = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return sketched.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(s).alias("fingerprint"), fingerprints.as_text(e).alias("edited_fingerprint"),
        fingerprints.resemblance(s, e).alias("near_edited"), fingerprints.resemblance(s, n).alias("near_next"),
        fingerprints.containment(s, e).alias("contained_in_edited"),
        fingerprints.distinct_shingles(s).alias("n_shingles_estimate"))


_TURNS = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
made AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS read_back,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('<|im_start|><|im_sep|><|im_end|>')
             + length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'))
             + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(read_back) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM made
""".replace("\\\\", "\\")


@register("op2_chat_format", _TURNS)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    # rows that share a turn stay apart, in the order of role and text
    same = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    order = ("turn", "row")
    events = chat.replay_events(rows.unionByName(extra).withColumn("row", F.row_number().over(same)), order)
    done = chat.format_chat(events, order)
    back = done.withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn(
        "loss", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns_text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@register("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@register("op5_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


@register("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("pii_base").cast("binary"), 256).alias("base_sha256"),
                        listed("pii_spans").alias("spans"))


@register("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks, pattern = bpe.read_ranks(path), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    digest = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary"), 256)
    encoded = encoded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"))
    return bpe.decode(encoded, ranks, pattern).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"),
                      (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


SHARDS = 24


@register("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                      "grown_shard")


# The host rules of the query; they decide before the default patterns.
HOST_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
              ("net/es/", "block"), ("net/fr/", "block")]

_JUDGED = r"""
WITH cut AS (
  SELECT page_id, instr(coalesce(url, ''), '://') AS mark, url FROM pages),
rest AS (
  SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM cut),
place AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(rest, '^[^/?#]*', '') AS tail FROM rest),
rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
                                ('net/es/', 'block'), ('net/fr/', 'block')),
parts AS (SELECT *, substr(rule, 1, instr(rule, '/') - 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path FROM rules),
places AS (SELECT DISTINCT host, path FROM place),
found AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM places, parts
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule,
       CASE WHEN verdict IS NOT NULL THEN verdict
            WHEN regexp_matches(p.host || tail, '^([^/?#]*\.)?(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)\.')
              OR regexp_matches(p.host || tail, '/wp-login\.php|/wp-admin/|/phpmyadmin/|/cgi-bin/|/\.git/|/xmlrpc\.php$')
              OR regexp_matches(p.host || tail, '(?s)/checkout/.*/payment([^A-Za-z0-9_.%-]|$)')
            THEN 'block' ELSE 'allow' END AS verdict
FROM place AS p LEFT JOIN found AS f ON p.host = f.host AND p.path = f.path
"""


@register("op11_url_filters", _JUDGED)
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = [urlfilter.host_rule(place, verdict, tier=1) for place, verdict in HOST_RULES]
    out = urlfilter.judge(pages, rules + urlfilter.DEFAULT_RULES)
    return out.select("page_id", "host", "path", F.when(F.col("rule_tier") == 1, F.col("rule")).alias("rule"), "verdict")


def _clustered() -> str:
    """The rounds written out; all sums in whole numbers."""
    def nearest(name: str, centroids: str) -> str:
        return f"""{name} AS MATERIALIZED (
  SELECT rid, vec_id, v, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
    SELECT rid, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::BIGINT AS d
    FROM vectors, {centroids}) GROUP BY rid, vec_id, v)"""
    steps = ["""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", """
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS w FROM vectors
  QUALIFY c < 40)"""]
    for i in range(5):
        steps += [nearest(f"a{i}", f"c{i}"), f"""s{i} AS (
  SELECT c, k, sum(v[k])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, 65) AS t(k) GROUP BY c, k)""", f"""m{i} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k)::BIGINT[] AS w FROM s{i} GROUP BY c)""",
                  f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.w, o.w) AS w FROM c{i} AS o LEFT JOIN m{i} AS m USING (c))"]
    steps.append(nearest("last", "c5"))
    return ",\n".join(steps) + """
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM last JOIN c5 USING (c)
"""


@register("op12_centroid_clustering", _clustered())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def planted(text: Column, doc_id: Column) -> Column:
    """The text, or, for a tenth of the ids, its words with a repetition:
    word i >= a is the original word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (g % 8 + 3)).cast("bigint")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda at: F.array_join(F.transform(w, lambda x, i: F.when(
            i < at["a"], x).otherwise(F.element_at(w, (at["a"] + (i - at["a"]) % at["p"] + 1).cast("int")))), " "))
    chosen = F.coalesce((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return F.when(chosen, let(words(text), repeated)).otherwise(text)


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.with_runs(docs).withColumn("best", periodic.most_periodic(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]),
                                                                 F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
