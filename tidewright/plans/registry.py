"""Every query by name, with its SQL twin where SQL can express it on whole tables."""

from __future__ import annotations

from tidewright.operators import backtest, books, consensus, features, forecast, hashing, indicators, inference, labels, learners, memory, regular_grid, rolling_totals, series_queries, sleeves, spikes, splits, vault
from tidewright.plans import evaluate, pooling
from tidewright.streaming import queries as streaming

QUERIES = {
    "p1_found": (spikes.p1_found, spikes.P1_SQL),
    "p1_flags": (spikes.p1_flags, None),
    "p2_rolling_totals": (rolling_totals.p2_rolling_totals, rolling_totals.P2_SQL),
    "p3_found": (regular_grid.p3_found, regular_grid.P3_FOUND_SQL),
    "p3_grid": (regular_grid.p3_grid, regular_grid.P3_GRID_SQL),
    "features": (features.q_features, features.FEATURES_SQL),
    "positions": (features.q_positions, features.POSITIONS_SQL),
    "panel_features": (features.q_panel, features.PANEL_SQL),
    "indicators_window": (indicators.q_window, indicators.WINDOW_SQL),
    "indicators_recursive": (indicators.q_recursive, None),
    "robust_normalized": (indicators.q_normalized, indicators.NORMALIZED_SQL),
    "interleaved": (indicators.q_interleaved, indicators.INTERLEAVED_SQL),
    "on_balance_volume": (indicators.q_obv, indicators.OBV_SQL),
    "triple_barrier": (labels.q_triple_barrier, labels.TRIPLE_SQL),
    "label_uniqueness": (labels.q_uniqueness, labels.UNIQUE_SQL),
    "cusum_events": (labels.q_cusum, labels.CUSUM_SQL),
    "purged_folds": (splits.q_purged, splits.PURGED_SQL),
    "sample_weights": (labels.q_sample_weights, labels.WEIGHTS_SQL),
    "combinatorial_folds": (splits.q_combinatorial, splits.CPCV_SQL),
    "fold_roles": (splits.q_roles, splits.ROLES_SQL),
    "walk_forward_folds": (splits.q_walk_forward, splits.WALK_SQL),
    "signal_backtest": (backtest.q_backtest, backtest.REPORT_SQL),
    "cost_ladder": (backtest.q_costs, backtest.COSTS_SQL),
    "fold_metrics": (backtest.q_folds, backtest.FOLDS_SQL),
    "fold_summary": (backtest.q_fold_summary, backtest.FOLD_SUMMARY_SQL),
    **series_queries.QUERIES,
    **forecast.QUERIES,
    **inference.QUERIES,
    **books.QUERIES,
    **vault.QUERIES,
    **hashing.QUERIES,
    **consensus.QUERIES,
    **learners.QUERIES,
    **evaluate.QUERIES,
    **pooling.QUERIES,
    **streaming.QUERIES,
    **memory.QUERIES,
    **sleeves.QUERIES,
}
