"""The queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, licenses, neardup, packing, pii, quality, sharding, topk, warc
from tessera.llm.common import scratch, text_crc
from tessera.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(F.pmod(text_crc("doc_id"), F.lit(3)) != 1)
    scored = quality.score(docs, quality.fit(docs, labels), keep=["doc_id"])
    return scored.select(
        "doc_id",
        (F.pmod(text_crc("doc_id"), F.lit(3)) == 1).alias("held_out"),
        "score",
        quality.passes(F.col("score")).cast("int").alias("predicted"),
    )


def op2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    pages = warc.read(spark, path, payload=False)
    return pages.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"), "valid",
    )


def op3_pivot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op4_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.col("notices.license"))), ",").alias("licenses"),
        F.to_json("notices").alias("notices"),
    )


def op5_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymize(_table(spark, sf_dir, "documents"), pii.session_key(spark), found="pii_kinds")
    return docs.select("doc_id", "text", F.size("pii_kinds").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("pii_kinds"))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(text_crc("doc_id"), F.lit(4)) == 2
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs.where(~held_out)), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.scan(docs, items, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), [1.0] * 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bradley_terry": op1_bradley_terry,
    "op2_segments": op2_segments,
    "op3_pivot_distance": op3_pivot_distance,
    "op4_conditional_compression": op4_conditional_compression,
    "op5_feistel": op5_feistel,
    "op6_cross_parsing": op6_cross_parsing,
    "op7_bagminhash": op7_bagminhash,
    "op8_winnowing": op8_winnowing,
    "op9_rendezvous": op9_rendezvous,
    "op10_sum_of_squares": op10_sum_of_squares,
}
SQL: dict[str, str] = {
    "op2_segments": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to, true AS valid
        FROM p LEFT JOIN f ON p.d = f.d
    """,
    "op3_pivot_distance": """
        WITH c AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
              FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op8_winnowing": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        iw AS (SELECT DISTINCT item, list_slice(w, p, p + 9) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(g) AS n FROM iw),
        dw AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
        h AS (SELECT doc_id, p, n, item FROM dw JOIN iw USING (g)),
        hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
        hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
    """,
    "op7_bagminhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        s AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, list_slice(w, p, p + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)) GROUP BY ALL),
        n AS (SELECT doc_id, sum(c) AS n, md5(string_agg(g::VARCHAR || c, ' ' ORDER BY g::VARCHAR)) AS bag FROM s GROUP BY 1),
        b AS (SELECT doc_id, coalesce(bag, 'no words: ' || body) AS bag FROM d LEFT JOIN n USING (doc_id)),
        m AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * m >= 8 * (x.n + y.n - m)
              UNION SELECT x.doc_id, y.doc_id FROM b x JOIN b y ON x.bag = y.bag AND x.doc_id <> y.doc_id),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT doc_id, least(doc_id, (SELECT min(r.b) FROM r WHERE r.a = doc_id)) AS class_id FROM b
    """,
    # crc32 bit by bit over the hexadecimal bytes; 3988292384 is its polynomial
    "op9_rendezvous": """
        WITH k AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(doc_id::VARCHAR, '') AS name FROM documents),
        c AS (SELECT doc_id, body, name, s, ('0x' || substr(md5(name || ':' || s), 1, 13))::BIGINT AS u FROM k, range(25) AS t(s)),
        b AS (SELECT doc_id, body, name, arg_max(s, u) FILTER (s < 24) AS shard, arg_max(s, u) AS grown FROM c GROUP BY ALL),
        t AS (SELECT list(list_reduce(range(8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, n::BIGINT) ORDER BY n) AS crc FROM range(256) AS r(n)),
        z AS (SELECT *, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT),
                lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM b, t)
        SELECT doc_id, octet_length(encode(body)) + 8 AS size, text_crc32, 'key' AS law, shard::INT AS shard, grown::INT AS grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(name), 1, 13))::BIGINT, doc_id) - 1 AS slot
        FROM z
    """,
}
