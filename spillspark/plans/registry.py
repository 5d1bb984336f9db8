"""Every registered query of the spill analytics, with its oracle SQL."""

from __future__ import annotations

from spillspark.plans import oracles, roundtrip_oracles, roundtrips
from spillspark.plans import queries as Q

NAMES = (
    "vessel_attribution_topk", "historical_attribution", "evidence_sentences", "evidence_matrix", "evidence_flags", "candidate_details",
    "contextual_traffic", "prototype_scores", "prototype_explanations", "ais_area_window_summary", "latest_position", "track_legs", "track_progress", "track_lines",
    "ais_dataset_stats", "search_area_cell_join", "polygon_window_filter", "drift_forward", "drift_backward", "impact_zone", "vessel_risk",
    "risk_counts", "risk_order", "synthetic_distances", "risk_features", "kpi_overview", "grid_interpolate", "hindcast_grid", "sar_calibrate", "sar_normalise", "mask_counts",
    "scene_stats", "scene_percentiles", "downsample", "mask_geometry", "components_tile", "components_scene", "top_components",
    "spill_totals", "georeferenced_components", "tile_scoring", "incident_readiness", "incremental_pending", "geojson_features", "report_facts", "candidate_distances",
    "mask_to_candidates",
)

QUERIES = {name: getattr(Q, name) for name in NAMES} | roundtrips.QUERIES
NAMES = tuple(QUERIES)
ORACLE_SQL = oracles.ORACLE_SQL | roundtrip_oracles.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
