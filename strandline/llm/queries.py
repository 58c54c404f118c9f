"""The registered queries of the corpus operators: one thin call for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform shuffle of all documents into shards 0 to 23."""
    from strandline.llm.sharding import shard_digest

    return shard_digest(_table(spark, sf_dir, "documents"))


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of all documents under a hidden Markov model."""
    from strandline.llm.hmm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as media, sniffed by signature and read back."""
    from strandline.llm.media import media_digest

    return media_digest(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in all documents through a positional index."""
    from strandline.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and fuzzy licence notices in all documents."""
    from strandline.llm.licenses import license_digest

    return license_digest(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from weak votes and training labels."""
    from strandline.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed to target weights."""
    from strandline.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by attention over their passages."""
    from strandline.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by word shingles."""
    from strandline.llm.jaccard import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "text_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents without exact and near repeats, counted by document."""
    from strandline.llm.lines import line_digest

    return line_digest(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all embeddings."""
    from strandline.llm.whitening import whitened_components

    return whitened_components(_table(spark, sf_dir, "embeddings"))


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold marks of the template, formatted in windows and read back."""
    from strandline.llm.chat import chat_digest

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.sql("SELECT -1L, turn, role, '</s>[INST] ok [/INST]' FROM VALUES (0L, 'user'), (1L, 'assistant') AS t (turn, role)")
    return chat_digest(turns.union(marked))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    from strandline.llm.ranking import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_hmm_scoring": op2_hmm_scoring,
        "op3_media_columns": op3_media_columns,
        "op4_decontamination": op4_decontamination,
        "op5_license_scan": op5_license_scan,
        "op6_toxicity": op6_toxicity,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_line_dedup": op10_line_dedup,
        "op11_whitening": op11_whitening,
        "op12_chat_windows": op12_chat_windows,
        "op13_ranked_search": op13_ranked_search,
        "pipeline": pipeline,
    }
