"""Explicit schemas; nothing here is inferred."""

from __future__ import annotations

MISSIONS = "id long, mission_name string, instrument_name string, description string, created_at timestamp"
SEQUENCES = "id long, mission_id long, instrument string, start_time timestamp, end_time timestamp, frame_count int, status string, created_at timestamp"
IMAGES = "id long, mission_id long, sequence_id long, source_identifier string, source_url string, local_path string, observation_time timestamp, instrument string, width int, height int, checksum string, size_bytes long, ingestion_status string, error_message string, created_at timestamp"
PREDICTIONS = "id long, candidate_id long, model_version string, run_id string, score double, created_at timestamp"

#: The features of a track, in the order in which they are defined. Fixed values.
FEATURES = (
    "n_frames", "frame_coverage", "duration_s", "path_length_px", "displacement_px", "speed_mean_px_s", "speed_std_px_s",
    "direction_deg", "direction_consistency", "accel_mean_px_s2", "curvature_rad_px", "linear_rms_px", "flux_mean", "flux_cv",
    "flux_slope_frac_h", "area_mean_px", "area_slope_frac_h", "r_min_px", "r_mean_px", "r_max_px", "radial_speed_px_s",
)
FEATURE_STRUCT = "struct<" + ",".join(f"{f}:{'bigint' if f == 'n_frames' else 'double'}" for f in FEATURES) + ">"
CANDIDATES = f"id long, track_id string, sequence_id long, n_frames int, start_time timestamp, end_time timestamp, features {FEATURE_STRUCT}, label string, status string, review string, reviewer_notes string, reviewed_at timestamp, created_at timestamp"

DETECTION = "struct<x:double,y:double,bbox:array<int>,area:int,peak:double,flux:double,snr:double>"
TRACK_POINTS = "sequence_id long, track_id string, seq int, frame string, ts timestamp, x double, y double, area double, flux double, residual double"

MANIFEST_ENTRY = "struct<status:string,source_url:string,recorded_at:string,sha256:string,size_bytes:bigint,date_obs:string,error:string>"
DAY_RECORD = "struct<sequence_id:bigint,positive_track_ids:array<string>>"
LABELS = (
    f"label_format string, events array<struct<soho_number:int,`group`:string,cameras:array<string>,obs_start:string,obs_end:string,source_file:string,source_line:string,status:string,notes:string,days:map<string,{DAY_RECORD}>>>, "
    "negative_days array<struct<day:string,camera:string,sequence_id:bigint,verified_against:array<string>>>, splits map<string,array<string>>"
)

#: Allowed values. Fixed values.
INGESTION_STATUSES = ("complete", "failed")
SEQUENCE_STATUSES = ("PENDING", "READY", "PROCESSING", "PROCESSED", "FAILED")
CANDIDATE_STATUSES = ("HIGH_PRIORITY", "MEDIUM_PRIORITY", "LOW_PRIORITY", "KNOWN_COMET", "LIKELY_ARTIFACT", "UNRESOLVED")
REVIEW_VERDICTS = ("approved", "rejected", "artifact", "known_object", "uncertain")
