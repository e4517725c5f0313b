"""One query per corpus operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import (
    bpe,
    decontamination,
    hnsw,
    jaccard,
    language,
    licenses,
    lines,
    runs,
    secrets,
    sharding,
    topk,
    toxicity,
    whitening,
)
from spanloom.llm.common import id_remainder, table, written

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle into 40 shards, row counts at most one apart."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    dealt = sharding.uniform_shards(rows, 40)
    return dealt.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that a document, a paragraph or a line of it is."""
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))
    return found.select("doc_id", "whole_license", F.array_join("licenses", ",").alias("licenses"), "n_found")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; a fifth of the documents is held out from learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(id_remainder(5) != 0))
    return toxicity.score(docs, model).select(
        "doc_id",
        (id_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join("telling", " ").alias("telling"),
    )


def bpe_digests(docs: DataFrame) -> DataFrame:
    model = vocabulary("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(docs, model, vocabulary("byte_bpe_50k.tiktoken")), model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe_digests(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside ten-word windows of benchmark items."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates and which of them are secrets; a fifth of the documents is held out from learning."""
    # Learning reads them twice and judging once more, so what their form says is worked out before.
    found = written(secrets.settled(secrets.described(secrets.candidates(table(spark, sf_dir, "documents")))), "candidates")
    model = secrets.train(secrets.certain_labels(found.where(id_remainder(5) != 0)))
    return secrets.judged(found, model).select(
        "doc_id",
        "line",
        "nth",
        F.sha2("candidate", 256).alias("candidate_sha256"),
        F.col("length").cast("int").alias("length"),
        (id_remainder(5) == 0).alias("held_out"),
        "probability",
        "is_secret",
    )


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best vectors for every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-grams, similarity of 0.85 or more."""
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, above=85, below=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of repeated three-line windows."""
    docs = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_removed", "text")


def language_model(docs: DataFrame) -> language.LanguageModel:
    """Learned from all documents that are not held out."""
    pieces = language.read_pieces(vocabulary("byte_bpe_50k.tiktoken"))
    return language.fit(docs.where(id_remainder(3) != 1), pieces)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; a third of the documents is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors for every twentieth vector, by graphs of all vectors."""
    vectors = written(hnsw.usable(table(spark, sf_dir, "embeddings")), "ann-vectors")
    return hnsw.nearest(hnsw.index(vectors, k=20), vectors.where("vec_id % 20 = 0"), k=20)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the 32 greatest components of their covariance, scaled to variance one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whitening.integers().alias("x"))
    white = whitening.whiten(vectors, whitening.fit(vectors, components=32))
    rows = white.select("vec_id", "whitening.*").select(
        "vec_id", "n", "deviation", "identity_error", F.explode("components").alias("c")
    )
    return rows.select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every text, and digests of the runs and of the text without repeated periods."""
    found = runs.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), prepared=True)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": licenses.scan_sql(),
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
    "op9_line_dedup": r"""
        WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
        places AS (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS i FROM split),
        windows AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY a[i], a[i + 1], a[i + 2] ORDER BY doc_id, i) AS nth
            FROM places WHERE translate(a[i] || a[i + 1] || a[i + 2], ' ' || chr(9) || chr(13), '') <> ''
        ),
        covered AS (
            SELECT DISTINCT doc_id, i + k AS spot
            FROM windows, (SELECT unnest([0, 1, 2]) AS k) AS ks WHERE nth > 1
        ),
        lines AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS spot FROM split),
        kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY spot) AS text, count(*) AS n
            FROM lines ANTI JOIN covered USING (doc_id, spot) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(len(a), 0) AS n_lines, coalesce(len(a), 0) - coalesce(kept.n, 0) AS n_removed,
               CASE WHEN split.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
        FROM split LEFT JOIN kept USING (doc_id)
    """,
}
