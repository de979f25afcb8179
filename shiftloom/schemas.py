"""Schemas of the tables that operators take and give."""

from __future__ import annotations

LAYERS = ("base", "sft", "dpo", "rlvr")
#: Pairs of training stages that metrics compare, earlier stage first.
PAIRS = (("base", "sft"), ("sft", "dpo"), ("base", "dpo"), ("dpo", "rlvr"), ("base", "rlvr"), ("sft", "rlvr"))

WORD_DIST = "family string, layer string, prompt string, word string, prob double"
TOKEN_LOGITS = "prompt long, layer string, token_id int, token string, logit double"
WORD_VEC = "prompt string, word string, net_layer int, vec array<float>"
TOKEN_VEC = "token_id int, vec array<float>"
SEQUENCE_LOGPROB = "layer string, prompt string, pos int, token_id int, logp double"
GENERATIONS = "gen_id long, family string, label string, prompt string, temperature double, model string, psg string, vec array<float>"
CONCEPT_SEED = "axis string, polarity string, vec array<float>"
MODEL_REGISTRY = "family string, display string, layer string, ord int, model_id string"
PROMPTS = "label string, prompt string, category string, tier1 boolean"
LENS = "model long, prompt long, net_layer int, token_id int, word string, probability double, logit double, source string"
STEP_METRICS = "step int, label long, entropy_base double, entropy_step double, entropy_drop double, js_base_step double, kl_base_step double, top_overlap double"
SHIFT = "prompt string, axis string, word string, base double, p_from double, p_to double, delta double, ratio double, down boolean, up boolean"
TOKEN_MASS = "family string, label string, category string, base_mass double, dpo_mass double, mass_displaced double"

#: Names that users of the earlier vocabulary know; see ``functions.text.stage_alias``.
STAGE_ALIASES = {"base": "base", "ego": "sft", "superego": "dpo", "instruct": "rlvr"}

#: Captions of the stages, in their order.
STAGE_LABELS = {"base": "BASE", "sft": "SFT", "dpo": "DPO", "rlvr": "RLVR"}
