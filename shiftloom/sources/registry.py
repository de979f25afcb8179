"""Model families and prompts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category_of
from ..schemas import LAYERS, MODEL_REGISTRY


# The families of checkpoints that come with the library, by stage.
FAMILIES = {
    "olmo": {"base": "allenai/Olmo-3-1025-7B", "sft": "allenai/Olmo-3-7B-Instruct-SFT", "dpo": "allenai/Olmo-3-7B-Instruct-DPO", "rlvr": "allenai/Olmo-3-7B-Instruct"},
    "llama": {"base": "meta-llama/Llama-3.1-8B", "dpo": "meta-llama/Llama-3.1-8B-Instruct"},
    "amber": {"base": "LLM360/Amber", "sft": "LLM360/AmberChat", "dpo": "LLM360/AmberSafe"},
    "qwen": {"base": "Qwen/Qwen2.5-7B", "dpo": "Qwen/Qwen2.5-7B-Instruct"},
}
DEFAULT_FAMILY = "olmo"
# Words that are followed over training steps, and the steps.
TRACKED_WORDS = {
    "sexual": ["cock", "dick", "penis", "fuck", "sex", "naked", "breasts"],
    "violence": ["kill", "murder", "stab", "blood", "smite", "Options", "what"],
    "displacement": ["big", "huge", "massage", "kiss", "read", "hands"],
    "neutral": ["the", "and", "said", "was", "his", "her"],
}
DEFAULT_STEPS = [1000, 5000, 10000, 15000, 20000, 25000, 30000, 35000, 40000, 43000]


def tracked_words(spark: SparkSession, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """(token, category, ord): a word that is on several lists counts for the first."""
    rows = [(w, c, k) for k, (w, c) in enumerate((w, c) for c, words in (lists or TRACKED_WORDS).items() for w in words)]
    return spark.createDataFrame(rows, "token string, category string, ord int")


def numbers(listed: str) -> list[int]:
    """The numbers of a comma-separated list."""
    return [int(x) for x in listed.split(",") if x.strip()]


def label_of(asked: DataFrame, prompts: DataFrame, labels: DataFrame) -> DataFrame:
    """(prompt, label): for each asked prompt the first (by ``ord``) of the labels that have its text and are among
    ``labels``; a prompt without one drops out. ``prompts``: ord, label, prompt."""
    known = prompts.join(labels.select("label").distinct(), "label", "left_semi")
    return known.join(asked.select("prompt").distinct(), "prompt", "left_semi").groupBy("prompt").agg(F.min_by("label", "ord").alias("label"))


def model_registry(spark: SparkSession, families: dict[str, dict[str, str]]) -> DataFrame:
    """{family: {stage: model id}} as rows; a stage that a family lacks has none."""
    for family, stages in families.items():
        if "base" not in stages or not ({"dpo", "sft"} & set(stages)) or ("sft" in stages and "dpo" not in stages):
            raise ValueError(f"{family}: a family has a base and a dpo stage, sft and rlvr besides if it has them")
    rows = [(f, f.capitalize(), s, LAYERS.index(s), m) for f, stages in families.items() for s, m in stages.items()]
    return spark.createDataFrame(rows, MODEL_REGISTRY)


def layer_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("family").agg(F.count("model_id").alias("n_layers"))


def prompt_table(spark: SparkSession, prompts: dict[str, str], first_tier: set[str] = frozenset()) -> DataFrame:
    rows = [(label, text, label in first_tier) for label, text in prompts.items()]
    return spark.createDataFrame(rows, "label string, prompt string, tier1 boolean").withColumn("category", category_of(F.col("label"))).select("label", "prompt", "category", "tier1")


def with_prefix(prompts: DataFrame, category: str) -> DataFrame:
    return prompts.where(F.col("label").startswith(category))
