"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import bpe, chat, codes, linedup, minhash, runs, secrets, sharding, simhash, spotsigs, tiling, tokencount, toxicity
from harvestry.sources.shared import table


VOCABULARY = "byte_bpe_50k.json"
#: Tokens above which a document is over the limit of op8.
TOKEN_LIMIT = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that quotes control strings, folded from logs, rendered, and read back."""
    quoted = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.render(chat.as_log(turns), "message")).withColumnRenamed("conv", "conv_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, 64 bits, linked at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), simhash.hex16("fingerprint").alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal counts, equal texts together."""
    found = sharding.balanced_shards(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a model that never saw the labels of the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.fold() != 1)
    found = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = (toxicity.fold("row.doc_id") == 1).alias("held_out")
    return found.select("row.doc_id", held_out, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of all documents and of their edited texts."""
    found = spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.as_string(F.col("signatures")).alias("fingerprint"),
        spotsigs.as_string(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by their SpotSigs sets, parted by length and compared behind rare prefixes (with operator 5)."""
    return spotsigs.similar_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand on many sites."""
    found = linedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.col("clean").alias("text"), "n_lines", "n_removed")


def op7_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole document and of the text that they decode to."""
    found = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole document."""
    found = tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: counts and digest of the base spans, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it leaks."""
    found = tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every whole document, of which a tenth is made to repeat itself, and digests of the texts without repetitions."""
    found = runs.periodic_runs(runs.repeat_tails(table(spark, sf_dir, "documents")), "id")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", runs.most_repeated(F.col("runs")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings: 4 parts, codebooks of 256 entries, 4 rounds."""
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    found = codes.with_label_errors(coded)
    return found.select(
        F.col("id").alias("vec_id"), codes.hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: sets of 3-word shingles with a Jaccard of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f for f in (
        op1_chat_formatting, op2_simhash_near_dedup, op3_sharding, op4_toxicity, op5_document_fingerprints, op6_line_dedup,
        op7_bpe_encoding_and_decoding, op8_token_counts, op9_secret_scans, op10_benchmark_decontamination, op11_periodic_runs, op12_vector_code_compression,
        op13_minhash_near_dedup, document_classes
    )
}


def _product_code_sql(parts: int = 4, size: int = 256, rounds: int = 4) -> str:
    """All parts against all entries, round by round; distances are whole numbers in doubles."""
    turns = []
    for r in range(rounds + 1):
        turns.append(f"""
        a{r} AS MATERIALIZED (
            SELECT x.vec_id, x.p, min(CAST(x.xx - 2 * list_inner_product(x.x, c.x) + c.xx AS BIGINT) * {size} + c.k) AS best
            FROM parts x JOIN c{r} c ON x.p = c.p GROUP BY x.vec_id, x.p)""")
        if r < rounds:
            turns.append(f"""
        m{r} AS (
            SELECT p, k, list(mean ORDER BY pos) AS x FROM (
                SELECT p, k, pos, floor(sum(v) / count(*)) AS mean FROM (
                    SELECT x.p, a.best % {size} AS k, unnest(x.x) AS v, generate_subscripts(x.x, 1) AS pos
                    FROM parts x JOIN a{r} a ON x.vec_id = a.vec_id AND x.p = a.p) GROUP BY p, k, pos) GROUP BY p, k),
        c{r + 1} AS MATERIALIZED (
            SELECT p, k, x, list_inner_product(x, x) AS xx
            FROM (SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.k = m.k))""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda e: floor(1024 * CAST(e AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, p, x, list_inner_product(x, x) AS xx FROM (
                SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, unnest(range({parts})) AS t(p))),
        c0 AS MATERIALIZED (SELECT p, k, x, xx FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < {size}),
        {",".join(turns)},
        told AS (
            SELECT a.vec_id, string_agg(printf('%02x', CAST(best % {size} AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best // {size}) AS BIGINT) AS error
            FROM a{rounds} a GROUP BY a.vec_id),
        books AS (
            SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, pos)) AS digest
            FROM (SELECT p, k, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM c{rounds}))
        SELECT t.vec_id, t.code, t.error, CAST(sum(t.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, digest AS codebooks_sha256
        FROM told t JOIN kept e ON t.vec_id = e.vec_id, books"""


ORACLES: dict[str, str] = {
    "op12_vector_code_compression": _product_code_sql(),
    "op1_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(11 + 2 * length(role || text) - length(regexp_replace(role || text, '[<\[\]\\]', '', 'g')))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op6_line_dedup": f"""
        WITH cut AS (
            SELECT doc_id, source, md5(coalesce(text, '')) AS digest, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM cut),
        bad AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key
            HAVING count(DISTINCT source) >= {linedup.MIN_SITES} AND count(DISTINCT digest) >= {linedup.MIN_SITES})
        SELECT doc_id,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.key IS NULL), '') AS text,
               count(*) AS n_lines,
               count(b.key) AS n_removed
        FROM keyed k LEFT JOIN bad b ON k.key = b.key GROUP BY doc_id""",
}
