"""Settings of all operators, as one frozen value that is passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    relevance_max_distance: float = 1.2
    final_max_distance: float = 0.65
    rrf_k: int = 60
    keyword_limit: int = 20
    keyword_distance: float = 0.8
    hide_archived: bool = True
    scope_filter: bool = False
    bundle_limit: int = 5
    bundle_distance: float = 0.85
    alpha_mention: float = 0.10
    alpha_recency: float = 0.05
    recency_days: float = 30.0
    alpha_age: float = 0.03
    age_days: float = 90.0
    boost_mode: str = "legacy"
    decay_d: float = 0.5
    actr_alpha: float = 0.2
    retrieval_threshold: float = -7.5
    noise: float = 1.0
    recall_interval: int = 6 * 3600
    history_kept: int = 10
    max_hops: int = 2
    gamma: float = 0.5
    min_activation: float = 0.05
    sibling_base: float = 0.9
    sibling_weight: float = 0.4
    sibling_min: float = 0.3
    priming_bonus: float = 0.1
    priming_ttl: int = 1800
    priming_max: int = 20
    fok_enabled: bool = False
    fok_no_memory: float = 1.1
    fok_weak: float = 0.75
    tier_live: float = -6.0
    tier_hot: float = -7.5
    tier_warm: float = -8.7
    gist_min_cluster: int = 3
    gist_max_importance: int = 3
    gist_max_clusters: int = 20
    schema_min_entities: int = 3
    schema_max_groups: int = 10
    replay_max_turns: int = 50
    min_importance: int = 2
    dedup_threshold: float = 0.85
    dedup_limit: int = 5
    dedup_low: float = 0.15
    dedup_high: float = 0.35
    batch_size: int = 10
    batch_turn_chars: int = 600
    header: str = "[Long-term memory — facts about this user]"
    legend: str = "(legend: imp=importance 1-5 / Live>Hot>Warm>Cold=freshness tier / [date]=last confirmed / [条件: ...]=only holds under that condition)"
    footer: str = "[End of Long-term memory]"

    @classmethod
    def of(cls, values: dict[str, str]) -> Settings:
        """From strings; values that can't be read keep the default."""
        out = {}
        for f in fields(cls):
            if f.name not in values:
                continue
            text, default = values[f.name], f.default
            try:
                out[f.name] = text.strip().lower() not in ("0", "false", "no", "off", "") if isinstance(default, bool) else type(default)(text)
            except ValueError:
                continue
        return cls(**out)


DEFAULT = Settings()
