"""The typed graph: node tables, edges and the relations between labels."""

from __future__ import annotations

from pyspark.sql import types as T

COMMON = (
    "id STRING, tenant_id STRING, user_id ARRAY<STRING>, memory_domain STRING, published BOOLEAN, importance DOUBLE, memory_strength DOUBLE, ttl DOUBLE,"
    " created_at TIMESTAMP, updated_at TIMESTAMP, expires_at TIMESTAMP, last_accessed_at TIMESTAMP, forgetting_policy STRING, time_origin STRING,"
    " provenance STRUCT<source: STRING, model_version: STRING, prompt_version: STRING, confidence: DOUBLE>"
)
_OWN = {
    "event": "summary STRING, `desc` STRING, t_abs_start TIMESTAMP, t_abs_end TIMESTAMP, source STRING, logical_event_id STRING, source_turn_ids ARRAY<STRING>, evidence_status STRING,"
    " evidence_confidence DOUBLE, evidence_count INT, event_confidence DOUBLE, topic_id STRING, topic_path STRING, tags ARRAY<STRING>, keywords ARRAY<STRING>, time_bucket ARRAY<STRING>,"
    " tags_vocab_version STRING, event_type STRING, action STRING, actor_id STRING, text_vector_id STRING, clip_vector_id STRING",
    "entity": "type STRING, name STRING, cluster_label STRING, manual_name STRING, face_vector_id STRING, voice_vector_id STRING, text_vector_id STRING",
    "place": "name STRING, geo_location STRING, floor STRING, area_type STRING",
    "time_slice": "kind STRING, t_abs_start TIMESTAMP, t_abs_end TIMESTAMP, t_media_start DOUBLE, t_media_end DOUBLE, granularity_level INT, parent_id STRING",
    "media_segment": "source_id STRING, t_media_start DOUBLE, t_media_end DOUBLE, recorded_at TIMESTAMP, has_physical_time BOOLEAN, duration_seconds DOUBLE, vector_id STRING, thumbnail_ref STRING, modality STRING",
    "evidence": "source_id STRING, algorithm STRING, algorithm_version STRING, confidence DOUBLE, embedding_ref STRING, bbox STRING, offset_in_segment DOUBLE, text STRING, utterance_id STRING, span_start INT, span_end INT, subtype STRING, extras MAP<STRING, STRING>",
    "utterance": "raw_text STRING, t_media_start DOUBLE, t_media_end DOUBLE, speaker_track_id STRING, asr_model_version STRING, lang STRING, segment_id STRING",
    "region": "name STRING, polygon STRING, room STRING, region_type STRING, parent_id STRING",
    "state": "subject_id STRING, property STRING, value STRING, raw_value STRING, confidence DOUBLE, valid_from TIMESTAMP, valid_to TIMESTAMP, last_seen_at TIMESTAMP, source_event_id STRING, status STRING",
    "pending_state": "subject_id STRING, property STRING, value STRING, raw_value STRING, confidence DOUBLE, valid_from TIMESTAMP, source_event_id STRING, status STRING, pending_reason STRING",
    "knowledge": "summary STRING, buckets_meta MAP<STRING, STRING>, data MAP<STRING, STRING>, registry_status STRING",
}
EDGE = (
    "tenant_id STRING, src_id STRING, dst_id STRING, rel_type STRING, confidence DOUBLE, role STRING, layer STRING, kind STRING, source STRING, status STRING, weight DOUBLE,"
    " first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, src_type STRING, dst_type STRING"
)
ENTRY = (
    "id STRING, kind STRING, modality STRING, contents ARRAY<STRING>, vectors MAP<STRING, ARRAY<FLOAT>>, published BOOLEAN, is_deleted BOOLEAN, tenant_id STRING, user_id ARRAY<STRING>,"
    " memory_domain STRING, run_id STRING, memory_scope STRING, source STRING, entities ARRAY<STRING>, character_id STRING, `timestamp` TIMESTAMP, created_at TIMESTAMP, ttl DOUBLE, importance DOUBLE, metadata MAP<STRING, STRING>"
)
#: The labels that each relation joins, from and to.
RELATIONS: dict[str, tuple[str, str]] = {
    "NEXT_SEGMENT": ("media_segment", "media_segment"),
    "CONTAINS_EVIDENCE": ("media_segment", "evidence"),
    "BELONGS_TO_ENTITY": ("evidence", "entity"),
    "SUMMARIZES": ("event", "media_segment"),
    "INVOLVES": ("event", "entity"),
    "OCCURS_AT": ("event", "place"),
    "NEXT_EVENT": ("event", "event"),
    "CO_OCCURS_WITH": ("entity", "entity"),
    "CAUSES": ("event", "event"),
    "SUPPORTED_BY": ("event", "evidence"),
    "COVERS_SEGMENT": ("time_slice", "media_segment"),
    "COVERS_EVENT": ("time_slice", "event"),
    "SPOKEN_BY": ("utterance", "entity"),
    "TEMPORALLY_CONTAINS": ("time_slice", "time_slice"),
    "SPATIALLY_CONTAINS": ("region", "region"),
    "HAS_STATE": ("entity", "state"),
    "TRANSITIONS_TO": ("state", "state"),
    "DERIVED_FROM": ("knowledge", "event"),
    "EQUIV": ("entity", "entity"),
    "MENTIONS": ("utterance", "entity"),
    "CONTAINS": ("media_segment", "utterance"),
    "STATED_BY": ("knowledge", "entity"),
    "FIRST_MEET": ("entity", "entity"),
}


def node_schema(label: str) -> T.StructType:
    return T._parse_datatype_string(f"{COMMON}, {_OWN[label]}")


def edge_schema() -> T.StructType:
    return T._parse_datatype_string(EDGE)


def entry_schema() -> T.StructType:
    return T._parse_datatype_string(ENTRY)
