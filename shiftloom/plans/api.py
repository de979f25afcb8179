"""Batch interface: many prompts at once, each result a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distributions, reports, shift, similarity, transfer
from ..sources.tables import KeyedTable


@dataclass
class Engine:
    """Analyses over source tables: ``word_dist`` (layer, prompt, word, prob), and, for what needs them, ``token_logits``
    (prompt, layer, token_id, token, logit) and ``word_vec`` (prompt, word, net_layer, vec)."""

    word_dist: DataFrame
    token_logits: DataFrame | None = None
    word_vec: DataFrame | None = None
    threshold: float = 0.01
    net_layers: tuple[int, ...] = (8, 16, 24)
    labels: DataFrame | None = field(default=None)

    @cached_property
    def stages(self) -> DataFrame:
        """Words by prompt with all stages' probabilities."""
        return distributions.merged_stages(self.word_dist, ["prompt"])

    def formation(self) -> DataFrame:
        return shift.formation(self.stages)

    def shift(self, a: str, b: str, with_base: bool = True) -> DataFrame:
        return shift.shift_table(self.stages, a, b, self.threshold, with_base)

    def id_scores(self) -> DataFrame:
        return shift.drive_scores(self.stages)

    def battery(self) -> DataFrame:
        return shift.battery_summary(self.shift("sft", "dpo"), ["prompt"])

    def metrics(self, k: int = 50) -> DataFrame:
        probs = distributions.softmax(self._need("token_logits"), ["prompt", "layer"])
        return distributions.metrics(distributions.pair_table(probs, ["prompt"], "token_id"), ["prompt", "pair"], "token_id", k)

    def displacement_map(self, least: float = 0.003, similar: float = 0.15, moved: float = 0.003) -> dict[str, DataFrame]:
        moves = similarity.movement(self.stages, moved, least)
        sims = similarity.similarity_join(moves, self._need("word_vec").where(F.col("net_layer").isin(list(self.net_layers))))
        pairs = sims.where(F.col("sim") >= similar)
        return {
            "moves": moves,
            "pairs": pairs,
            "matrix": similarity.similarity_matrix(sims, self.net_layers),
            "links": similarity.best_links(sims, self.net_layers[len(self.net_layers) // 2], similar, 4),
            "orphans": similarity.orphans(moves, pairs.select("prompt", "axis", "source")),
        }

    def displacement(self, net_layer: int = 16, similar: float = 0.3, falls: float = 0.005, share: float = 0.0005, permitted: float = 0.001) -> dict[str, DataFrame]:
        gone = transfer.suppressed(self.stages, falls)
        allowed = transfer.permitted(self.stages, gone, permitted)
        vectors = self._need("word_vec").where(F.col("net_layer") == net_layer).drop("net_layer")
        links = transfer.edges(gone, allowed, vectors, F.col("effective_mass"), None, similar, share, stems=True)
        moved = transfer.redistributed(self.stages, gone, allowed, links)
        return {"suppressed": gone, "edges": links, "transferred": moved, "absorption": transfer.absorption(links), "analysis": transfer.analysis(self.stages, moved, gone, links)}

    def focused_shift(self, a: str = "base", b: str = "sft", k: int = 20) -> DataFrame:
        """The shift over the union of all stages' first ``k`` tokens, each stage scored on all of them."""
        logits = self._need("token_logits")
        first = distributions.top_k(logits, ["prompt", "layer"], [F.desc("logit"), "token_id"], k)
        scored = distributions.restricted(logits, first, ["prompt"], "token_id").withColumn("word", F.col("token").cast("string"))
        return shift.shift_table(distributions.merged_stages(scored, ["prompt"]), a, b, self.threshold)

    def analyze(self, prompts: DataFrame) -> "Engine":
        """The engine for some prompts (a column ``prompt``) alone."""
        of = lambda t: None if t is None else t.join(prompts.select("prompt").distinct(), "prompt", "left_semi")
        return Engine(of(self.word_dist), of(self.token_logits), of(self.word_vec), self.threshold, self.net_layers, self.labels)

    def cached_formation(self, cache: KeyedTable, prompts: DataFrame, batch: int = 0) -> DataFrame:
        """The formation of the prompts, worked out only for those that the cache (keyed by prompt) lacks."""
        return cache.read_through(prompts, lambda missing: self.analyze(missing).formation(), batch)

    def formation_report(self, least: float = 0.005, n: int = 15) -> DataFrame:
        """Lines of text: what each stage brings in and takes away."""
        out = None
        for a, b, down, up in (("base", "sft", "sublimated", "introduced"), ("sft", "dpo", "repressed", "amplified"), ("dpo", "rlvr", "further suppressed", "further amplified")):
            part = reports.shift_sections(self.shift(a, b), down, up, least, n)
            out = part if out is None else out.unionByName(part)
        return out

    def shift_report(self, n: int = 15) -> DataFrame:
        return reports.ratio_sections(self.shift("sft", "dpo"), n)

    def metrics_report(self, k: int = 50) -> DataFrame:
        return reports.metric_lines(self.metrics(k))

    def pairs_report(self, n: int = 25) -> DataFrame:
        return reports.pair_lines(self.displacement_map()["pairs"], n)

    def report(self, n: int = 10) -> DataFrame:
        """Lines of text: the largest shifts of each prompt, largest first."""
        rows = self.shift("sft", "dpo").where("down OR up").withColumn("size", F.abs("delta"))
        best = distributions.top_k(rows, ["prompt"], [F.desc("size"), "word"], n, "rank")
        return best.select("prompt", "rank", F.format_string("%-20s %.4f -> %.4f (%+.4f)", "word", "p_from", "p_to", -F.col("delta")).alias("line"))

    def _need(self, name: str) -> DataFrame:
        table = getattr(self, name)
        if table is None:
            raise ValueError(f"this analysis needs {name}")
        return table
