"""Fixed schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

DETECTION = ("stream_id STRING, frame_idx BIGINT, t_sec DOUBLE, det_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, conf DOUBLE, class_id INT, tile_source STRING, truth_agent_id BIGINT")
TRAJECTORY = ("frame_idx BIGINT, timestamp_s DOUBLE, track_id BIGINT, bbox_x1 DOUBLE, bbox_y1 DOUBLE, bbox_x2 DOUBLE, bbox_y2 DOUBLE, conf DOUBLE, foot_px_x DOUBLE, foot_px_y DOUBLE, world_x_m DOUBLE, world_y_m DOUBLE, in_quad INT, tile_source STRING")
VELOCITY = ("frame_id BIGINT, t_sec DOUBLE, track_id BIGINT, x_world DOUBLE, y_world DOUBLE, v_x DOUBLE, v_y DOUBLE, window_full BOOLEAN")
DENSITY = ("frame_id BIGINT, t_sec DOUBLE, in_quad BIGINT, density_persons_per_m2 DOUBLE, peak_cell_density_persons_per_m2 DOUBLE")
TRUTH = ("frame_id BIGINT, agent_id BIGINT, x_world DOUBLE, y_world DOUBLE")
CAMERA = "camera STRUCT<position_m: ARRAY<DOUBLE>, look_at_m: ARRAY<DOUBLE>, up_hint: ARRAY<DOUBLE>, fov_deg: DOUBLE, image_width_px: INT, image_height_px: INT>"
CALIBRATION = (
    "video STRING, frame_index BIGINT, video_resolution ARRAY<BIGINT>, image_points ARRAY<ARRAY<DOUBLE>>, world_points ARRAY<ARRAY<DOUBLE>>, H ARRAY<ARRAY<DOUBLE>>, H_inv ARRAY<ARRAY<DOUBLE>>, "
    "world_width_m DOUBLE, world_height_m DOUBLE, source STRING, note STRING, timestamp STRING, round_trip_error_px DOUBLE, near_edge_scale_m_per_px DOUBLE, far_edge_scale_m_per_px DOUBLE"
)


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return [c.split()[0] for c in ddl.split(", ")]
