"""Registered queries ``opN_*``: each operator over its whole test table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    bpe,
    exact_dedup,
    language_id,
    line_dedup,
    minhash,
    multi_index,
    packing,
    periodic_runs,
    phrases,
    secret_scan,
    token_count,
    toxicity,
    warc,
)
from tessera.llm.common import stage, table

TOKEN_LIMIT = 2048


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, "doc_id", "text")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_dups(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_dup_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.code_documents(docs, path).select(
        "doc_id", F.floor(F.octet_length("token_ids") / 4).alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stage(warc.write_archives(table(spark, sf_dir, "pages")), "archives")
    return warc.read_archives(archives).where("record_type <> 'gap'").select(
        F.nullif("record_id", F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs).select("doc_id", "secrets")

    def n(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("secrets", lambda s: s["kind"].isin(secret_scan.BASE))
    return found.select("doc_id", *map(n, secret_scan.BASE),
                        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return phrases.collocations(docs).withColumnRenamed("grp", "lang")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def looped_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document by h = crc32(doc_id), the n words
    from a on become repeats of the first p words from a, where
    a = floor(h / 10) % n and p = 1 + floor((n - a) / (3 + floor(h / 10) % 8))."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    chosen = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("chosen"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    counted = chosen.withColumn("words", words).withColumn("n", F.size("words"))
    placed = counted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    loop = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(loop, F.lit(1), rest)), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(looped_documents(table(spark, sf_dir, "documents"))).select("doc_id", "runs", "collapsed_text")

    def better(best: Column, run: Column) -> Column:
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
                    F.call_function("div", 1000 * F.col("best")["length"], F.col("best")["period"]).alias("exponent_milli"),
                    F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
                    F.sha2(F.encode("collapsed_text", "UTF-8"), 256).alias("collapsed_sha256")))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_minhash, op3_packing, op4_multi_index, op5_bpe_codec, op6_warc, op7_toxicity, op8_secret_scan,
    op9_line_dedup, op10_token_counts, op11_phrases, op12_language_id, op13_periodic_runs)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

SQL = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM t""",
    "op2_minhash": f"""
        WITH RECURSIVE
             w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
                   FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
                   FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
                   WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
             r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.y, r.low FROM r JOIN l ON l.x = r.node)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.low) AS component_id, d.doc_id = min(r.low) AS kept
        FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op4_multi_index": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
                   AND list_cosine_similarity(a.e, b.e) >= 0.95),
             r AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT l.y, r.low FROM r JOIN l ON l.x = r.node)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, min(low) AS component_id, vec_id = min(low) AS kept
        FROM v JOIN r ON r.node = vec_id GROUP BY vec_id""",
    "op6_warc": """
        WITH t AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                          sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op9_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
             k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
             g AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20
                   GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
             d AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.last_id AS gone FROM k LEFT JOIN g ON k.key = g.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
    "op11_phrases": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({_LOWER}, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents),
             i AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
             w AS (SELECT lang, id, unnest(words) AS a, generate_subscripts(words, 1) AS pos FROM i),
             s AS (SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
             g AS (SELECT lang, 1 AS d, a AS phrase, NULL AS l1, NULL AS r1, NULL AS l2, NULL AS r2, count(*) AS f FROM s GROUP BY lang, a
                   UNION ALL SELECT lang, 2, a || ' ' || b, a, b, NULL, NULL, count(*) FROM s WHERE b IS NOT NULL GROUP BY lang, a, b
                   UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, a, b || ' ' || c, a || ' ' || b, c, count(*)
                   FROM s WHERE c IS NOT NULL GROUP BY lang, a, b, c),
             n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
             c AS (SELECT * FROM g WHERE d > 1 AND f >= 10),
             cuts AS (SELECT lang, phrase, d, f AS a, 1 AS k, l1 AS lp, r1 AS rp FROM c
                      UNION ALL SELECT lang, phrase, d, f, 2, l2, r2 FROM c WHERE d = 3),
             x AS (SELECT cuts.*, gl.f AS l, gr.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(gl.f AS HUGEINT) * gr.f) AS BIGINT) AS score
                   FROM cuts JOIN g gl ON gl.lang = cuts.lang AND gl.phrase = lp JOIN g gr ON gr.lang = cuts.lang AND gr.phrase = rp),
             b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, l2 AS phrase, f FROM c WHERE d = 3
                        UNION ALL SELECT lang, r1, f FROM c WHERE d = 3) GROUP BY lang, phrase)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n.n, score
        FROM b JOIN n ON n.lang = b.lang LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase
        WHERE d = 3 OR longer.f IS NULL OR 100 * longer.f < 50 * a QUALIFY rank <= 2000""",
}
