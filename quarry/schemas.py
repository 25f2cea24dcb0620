"""Schemas of the catalog's relations, and what a cache clear may delete."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class DataClass(Enum):
    REBUILDABLE = "rebuildable"
    USER_OWNED = "user_owned"
    MARKER = "marker"


@dataclass(frozen=True)
class Relation:
    name: str
    ddl: str
    key: tuple[str, ...]
    data_class: DataClass

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


_BOXES = "face_box ARRAY<DOUBLE>, body_box ARRAY<DOUBLE>"
_R, _U, _M = DataClass.REBUILDABLE, DataClass.USER_OWNED, DataClass.MARKER

RELATIONS = {
    r.name: r
    for r in (
        Relation("asset", "id STRING, path STRING, name STRING, extension STRING, kind STRING, size_bytes BIGINT, modified_at_ms BIGINT, has_sidecar BOOLEAN, rating TINYINT, color_label STRING, pick_label STRING", ("id",), _R),
        Relation("library_root", "path STRING, added_at BIGINT, sort_order BIGINT", ("path",), _U),
        Relation("indexed_asset", "root_path STRING, path STRING, parent_path STRING, id STRING, name STRING, extension STRING, kind STRING, modified_at_ms BIGINT, size_bytes BIGINT, has_sidecar BOOLEAN, scan_id BIGINT", ("root_path", "path"), _R),
        Relation("directory", "root_path STRING, path STRING, parent_path STRING, name STRING, has_children BOOLEAN, scan_id BIGINT", ("root_path", "path"), _R),
        Relation("burst_frame", "position INT, path STRING, sequence_number INT, release_mode STRING, captured_at STRING", ("position",), _R),
        Relation("custom_tag", "id BIGINT, parent_id BIGINT, name STRING, name_key STRING, sort_order BIGINT", ("id",), _U),
        Relation("asset_tag", "asset_path STRING, tag_id BIGINT", ("asset_path", "tag_id"), _U),
        Relation("asset_tag_source", "asset_path STRING, tag_id BIGINT, source_kind STRING, source_id STRING", ("asset_path", "tag_id", "source_kind", "source_id"), _U),
        Relation("tag_sync_queue", "asset_path STRING, requested_at BIGINT, attempt_count INT, last_error STRING", ("asset_path",), _U),
        Relation("projection", "path STRING, parent_path STRING, projection_kind STRING, source_revision STRING, valid_at BIGINT, state_revision BIGINT, status STRING, rating TINYINT, color_label STRING, pick_label STRING, result_json STRING, error STRING", ("path", "projection_kind"), _R),
        Relation("metadata_tag", "path STRING, ord INT, group STRING, name STRING, value STRING", ("path", "ord"), _R),
        Relation("xmp_sidecar", "path STRING, xml STRING", ("path",), _U),
        Relation("detection", f"folder_path STRING, asset_path STRING, instance_id STRING, source_revision STRING, producer_fingerprint STRING, {_BOXES}, face_landmarks ARRAY<ARRAY<FLOAT>>, face_score FLOAT, body_score FLOAT", ("folder_path", "asset_path", "producer_fingerprint", "instance_id"), _R),
        Relation("feature", "feature_row_id BIGINT, folder_path STRING, asset_path STRING, instance_id STRING, source_revision STRING, feature_space_id STRING, pipeline_fingerprint STRING, vector ARRAY<FLOAT>", ("feature_row_id",), _R),
        Relation("anchor", f"side STRING, id STRING, source_identity_revision STRING, {_BOXES}, needs_review BOOLEAN", ("side", "id"), _U),
        Relation("manual_instance", f"id STRING, folder_path STRING, asset_path STRING, source_revision STRING, source_identity_revision STRING, {_BOXES}, needs_review BOOLEAN, revision BIGINT", ("id",), _U),
        Relation("review", "instance_id STRING, person_id STRING, decision STRING, revision BIGINT", ("instance_id", "person_id"), _U),
        Relation("analysis_run", "run_id STRING, folder_path STRING, request_id STRING, generation BIGINT, state STRING, sealed BOOLEAN, total INT", ("run_id",), _R),
        Relation("analysis_task", "run_id STRING, asset_path STRING, source_revision STRING, stage_id STRING, stage_fingerprint STRING, stage_order INT, state STRING, claim_token STRING, error STRING", ("run_id", "asset_path", "stage_id"), _R),
        Relation("artifact", "path STRING, size_bytes BIGINT, modified TIMESTAMP, leased BOOLEAN, staging BOOLEAN", ("path",), _R),
        Relation("completed_index", "root_path STRING, scan_id BIGINT", ("root_path",), _M),
        Relation("cache_format", "name STRING, version INT", ("name",), _M),
    )
}


def clearable() -> list[str]:
    """The relations a cache clear empties: what can be rebuilt, and the markers that say it was built."""
    return [r.name for r in RELATIONS.values() if r.data_class is not DataClass.USER_OWNED]
