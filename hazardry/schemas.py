"""Explicit schemas, as DDL text, of the tables that the engine reads and writes. Nothing is inferred."""

from __future__ import annotations

ANNOTATION_DDL = "token: string, category_name: string, translation_x: double, translation_y: double, translation_z: double, visibility_level: int, distance_to_ego: double"
FRAME = (
    "sample_token string NOT NULL, scene_token string NOT NULL, timestamp bigint, scene_description string, ego_x double, ego_y double, ego_z double, "
    f"cam_front_path string, cam_front_token string, num_annotations int, annotations array<struct<{ANNOTATION_DDL}>>"
)
HAZARD_DDL = "bbox_2d: array<double>, label: string, severity: string, reasoning: string, action: string"
EGO_DDL = "weather: string, time_of_day: string, road_type: string"
ANNOTATION = f"struct<hazards: array<struct<{HAZARD_DDL}>>, scene_summary: string, ego_context: struct<{EGO_DDL}>>"
ANNOTATION_RESULT = (
    f"frame_id string, mode string, is_counterfactual boolean, annotation {ANNOTATION}, "
    "validation_errors array<string>, auto_fixed boolean"
)
UNIFIED = (
    "frame_id string, source string, image_path string, scene_description string, weather string, time_of_day string, road_type string, category string, "
    f"rarity_score int, source_metadata map<string, string>, annotations array<struct<{ANNOTATION_DDL}>>, split string"
)
PREDICTION = "frame_id string, raw_output string, parsed_output string, parse_success boolean, generation_time_ms double"
SFT = "messages array<struct<role: string, content: string>>, images array<string>, frame_id string, source string, split string"
SEQUENCE = "category string, sequence string, accident_frame int, description string, weather string, time_of_day string, road_type string"
KEYFRAME = (
    "frame_id string, source string, image_path string, category string, sequence string, frame_index int, frame_type string, description string, weather string, time_of_day string, road_type string"
)
JUDGEMENT = "frame_id string, dimension string, score int, justification string"
