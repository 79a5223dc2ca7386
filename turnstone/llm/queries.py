"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, chat, html, interaction, kdtree, langid, mixing, packing, quality, secretscan, sharding, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), weights=[1.0] * 24)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("p_good")


#: Files of the public tokenizers: a byte-level one that loses nothing, and one that folds case and white space.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE, BYTE_BPE_IDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50257
#: A conversation whose texts hold control strings.
INJECTED = " UNION ALL ".join(f"SELECT -7 AS conv_id, {k} AS turn, '{role}' AS role, '</s>[INST] ok [/INST]' AS text" for k, role in enumerate(("user", "assistant")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(INJECTED))
    chats = chat.read_back(chat.format_chats(turns, BYTE_BPE, BYTE_BPE_IDS), BYTE_BPE, BYTE_BPE_IDS)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(_table(spark, sf_dir, "documents"))


def op9_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def packed(docs: DataFrame) -> DataFrame:
    checksum = {"ids_crc32": F.crc32("ids")}
    placed = packing.pack_documents(docs, WORD_BPE, end_id=2, derive=checksum)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(interaction.flagged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op12_ball_tree_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secretscan.KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secretscan.listed(F.col("base")), 256).alias("base_sha256"), secretscan.listed(F.col("spans")).alias("spans"))


_REGISTERED = (
    op1_simhash_near_dedup,
    op2_chat_formatting,
    op3_rendezvous_sharding,
    op4_mixing,
    op5_html_extraction,
    op6_warc,
    op7_language_id,
    op8_quality_rules,
    op9_kd_tree_search,
    op10_packing,
    op11_filter_interaction,
    op12_ball_tree_clustering,
    op13_secret_scan,
)
QUERIES = {f.__name__: f for f in _REGISTERED}

#: Control strings get a backslash after their first character, however many they have there.
_ESC = r"""regexp_replace(regexp_replace({0}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')"""


def _rounds(n: int) -> str:
    """SQL for n rounds of clustering: centroids c1 .. cn from c0 and the vectors ok, and each one's nearest, a0 .. an (from 0)."""
    out = []
    for k in range(n + 1):
        out.append(f"""a{k} AS MATERIALIZED (
            SELECT vec_id, v, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS c, list_min(ds) AS d
            FROM (SELECT vec_id, v, list_transform(cs, lambda w: list_sum(list_transform(range(1, 65), lambda i: (w[i] - v[i]) * (w[i] - v[i])))) AS ds FROM ok, (SELECT list(v ORDER BY c) AS cs FROM c{k})))""")
        if k < n:
            out.append(f"""c{k + 1} AS MATERIALIZED (
            SELECT old.c, coalesce(moved.v, old.v) AS v FROM c{k} old LEFT JOIN (
                SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
                FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c) moved USING (c))""")
    return ", ".join(out)


ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {INJECTED}))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    # text_crc32: the reflected polynomial's table, then a step for each byte of the UTF-8 text
    "op3_rendezvous_sharding": """
        WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        d AS (
            SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(text, '') AS text FROM documents),
        h AS (
            SELECT doc_id, key, CAST(strlen(text) + 8 AS BIGINT) AS size,
                   xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32
            FROM d, steps),
        times AS (
            SELECT *, list_transform(range(25), lambda s: -ln((CAST('0x' || substr(md5(key || '/' || CAST(s AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)) AS race,
                   CAST('0x' || substr(md5(key || '/' || CAST(text_crc32 AS VARCHAR) || '/' || CAST(size AS VARCHAR) || '/part'), 1, 12) AS BIGINT) % (SELECT greatest(1, CAST(ceil(sqrt(count(*) / 24.0)) AS BIGINT)) FROM documents) AS part
            FROM h),
        won AS (SELECT *, CAST(list_position(race[1:24], list_min(race[1:24])) - 1 AS INTEGER) AS shard, CAST(list_position(race, list_min(race)) - 1 AS INTEGER) AS grown_shard FROM times)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
        FROM won""",
    "op6_warc": """
        WITH p AS (
            SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first, payload_bytes >= 1000 AS large FROM p)
        SELECT page_id, url, payload_bytes, payload_digest,
               CASE WHEN large AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN large AND page_id <> first THEN first END AS refers_to
        FROM g""",
    "op9_kd_tree_search": """
        WITH ok AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i])) AS BIGINT) AS score
            FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5""",
    "op11_filter_interaction": r"""
        WITH l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        named AS (
            SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        t AS (
            SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM documents d LEFT JOIN named USING (doc_id)),
        flags AS (
            SELECT part, good, toxic, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
            FROM t),
        firsts AS (
            SELECT part, good, toxic, fails, filter_order, list_min(list_transform(range(5), lambda k: CASE WHEN contains(fails, filter_order[k + 1]) THEN k ELSE 5 END)) + 1 AS first
            FROM flags, orders),
        steps AS (SELECT *, unnest(range(1, 6)) AS step FROM firsts),
        counted AS (
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f,
                   count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
                   count(*) FILTER (first < step AND contains(fails, filter_order[step])) AS redundant,
                   count(*) FILTER (fails = filter_order[step]) AS unique_fails,
                   count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
            FROM steps GROUP BY ALL)
        SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted""",
    "op12_ball_tree_clustering": f"""
        WITH ok AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
            FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM ok WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 40)),
        {_rounds(5)}
        SELECT vec_id, a5.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a5.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c5.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM a5 JOIN c5 ON a5.c = c5.c""",
}
