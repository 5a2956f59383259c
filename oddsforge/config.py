"""Configuration dataclasses shared by the operators."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

# Fixed values (must equal the reference's defaults).
ROLLING_WINDOWS_DAYS = (1, 3, 7, 14, 30, 90)
TFIDF_MAX_FEATURES = 300
OUTLIER_THRESHOLD = 1.5
RATING_WEIGHTS = {
    "frequency": 0.25,
    "monetary": 0.25,
    "success": 0.30,
    "engagement": 0.10,
    "timing": 0.10,
}
HYBRID_WEIGHTS = {"collaborative": 0.4, "content_based": 0.3, "contextual": 0.3}
LEADERBOARD_WEIGHTS = {"auc": 0.4, "precision_at_5": 0.3, "diversity": 0.2, "coverage": 0.1}
RANKING_KS = (5, 10, 20)


@dataclass(frozen=True)
class ModelConfig:
    n_factors: int = 50
    reg: float = 0.01
    max_iter: int = 10
    mf_turns: int = 10           # turns of biases and factors, ended early on validation rows,
    mf_patience: int = 2         # after so many without a lower loss
    n_trees: int = 1000          # the fit stops early on its validation rows
    max_depth: int = 6
    tree_patience: int = 50      # trees without a lower validation loss
    network_hidden: int = 64
    network_width: int = 16
    network_steps: int = 60
    hybrid_weights: dict = field(default_factory=lambda: dict(HYBRID_WEIGHTS))
    ucb_alpha: float = 1.0
    epsilon: float = 0.1
    epsilon_decay: float = 0.99
    epsilon_every: int = 100
    seed: int = 42


def ts(value: str) -> _dt.datetime:
    """Parse an ISO timestamp literal used as ``as_of``."""
    return _dt.datetime.fromisoformat(value)
