"""Engine configuration.

The defaults are the experiment settings the results must be compared
under; they are fixed values, kept together here.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the experiment (must equal the published setup).
SEEDS = (42, 43, 44, 45, 46, 47, 48, 49, 50, 51)
DEPTH_SHALLOW = 8
DEPTH_DEEP = 11
DEEP_FEATURE_LIMIT = 100  # more features than this -> deep tree
FOCAL_ALPHA = 1.0
FOCAL_GAMMA = 2.0
LEARNING_RATE = 0.01
MAX_EPOCHS = 10000
PATIENCE = 10
MIN_IMPROVEMENT = 1e-4
VALID_FRACTION = 0.20
TEST_FRACTION = 0.20
BALANCE_RATIO = 0.25
QUANTILE_NOISE = 1e-3
QUANTILE_NOISE_SEED = 42
N_QUANTILES = 1000
MI_NEIGHBOURS = 3
ADAM_BETA1 = 0.9
ADAM_BETA2 = 0.999
ADAM_EPS = 1e-8


@dataclass
class EngineConfig:
    seeds: tuple[int, ...] = SEEDS
    depth: int | None = None  # None -> choose_depth(n_features)
    alpha: float = FOCAL_ALPHA
    gamma: float = FOCAL_GAMMA
    learning_rate: float = LEARNING_RATE
    max_epochs: int = MAX_EPOCHS
    patience: int = PATIENCE
    min_improvement: float = MIN_IMPROVEMENT
    valid_fraction: float = VALID_FRACTION
    test_fraction: float = TEST_FRACTION
    normalization: str = "quantile"  # quantile | min-max | mean
    quantile_noise: float = QUANTILE_NOISE
    quantile_noise_seed: int = QUANTILE_NOISE_SEED
    n_quantiles: int = N_QUANTILES
    quantile_method: str = "exact"  # exact | approx
    mi_method: str = "knn"  # knn | binned
    mi_neighbours: int = MI_NEIGHBOURS
    packed_trials: bool | None = None  # rows kept once for all trials; None: where trials run in batches
    rebalance: str | None = None  # None | random | smote: training rows of small classes
    balance_ratio: float = BALANCE_RATIO
    restore: str = "best"  # best (copy of best weights) | last (reference parity)
