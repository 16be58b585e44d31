"""The engine's normative constants, in one place."""

MAD_TO_SIGMA = 1.4826
MIN_SCOPE_SAMPLES = 30
RELATIVE_SIGMA_FLOOR = 0.01
ZERO_INFLATION_SHARE = 0.40
MIN_INFORMATIVE = 12
MIN_NUMERIC_VALUES = 3
ROLLING_SPREAD_FLOOR = 0.05

DETECTORS = ("robust_deviation", "categorical_rarity", "isolation_forest", "rolling_quantile", "change_point", "peer_group")
DETECTOR_WEIGHTS = {
    "robust_deviation": 1.0, "categorical_rarity": 0.8, "isolation_forest": 0.7,
    "rolling_quantile": 0.9, "change_point": 0.8, "peer_group": 1.0,
}
DETECTOR_VERSION = "v1"
ENTITY_LEVEL_DETECTORS = ("peer_group", "change_point")

ROBUST_KNEE, ROBUST_REASON = 3.0, 0.40
RARITY_REASON = 0.90
FOREST_MIN_ROWS, FOREST_TREES, FOREST_SEED, FOREST_REASON, FOREST_GAIN = 50, 100, 71, 0.40, 2.5
ROLLING_MIN_HISTORY, ROLLING_QUANTILE, ROLLING_REASON = 12, 0.9, 0.35
CHANGE_MIN_HISTORY, CHANGE_MIN_SEGMENT, CHANGE_STRENGTH = 20, 5, 0.35
PEER_MIN_EVENTS, PEER_MIN_ENTITIES, PEER_KNEE, PEER_REASON = 25, 8, 2.5, 0.45

AGREEMENT_WEIGHT = 0.5
FIRING_SCORE = 0.4
SEVERITY_CUTS = ((85.0, "critical"), (70.0, "high"), (50.0, "medium"))

MIN_SCORE, MIN_CONFIDENCE, DEDUP_HOURS, MAX_OPEN_PER_ENTITY = 60.0, 0.5, 72, 3
LIVE_STATUSES = ("open", "acknowledged", "in_progress")
HISTORY_LIMIT, TRAIN_RATIO = 400, 0.6

SIMILARITY_WEIGHTS = {"reasons": 0.40, "entity": 0.15, "scope": 0.15, "severity": 0.10, "numeric": 0.20}
SIMILARITY_FLOOR, SIMILARITY_LIMIT = 0.25, 5

FEEDBACK_PER_DETECTOR, FEEDBACK_OVERALL, WEIGHT_FLOOR, WEIGHT_STEP, WEIGHT_MIN_CHANGE = 8, 15, 0.25, 0.5, 0.01
REJECT_SHARE, SCORE_STEP, SCORE_CAP = 0.5, 1.0, 90.0
POLICY_SUPPORT, POLICY_CEILING, POLICY_MARGIN = 3, 95.0, 2.0
CONFIRMING_LABELS = ("true_exception",)
REJECTING_LABELS = ("false_positive", "expected_behavior")
LABELS = ("true_exception", "false_positive", "expected_behavior", "duplicate", "data_quality_issue")
STATUSES = ("open", "acknowledged", "in_progress", "resolved", "dismissed")
