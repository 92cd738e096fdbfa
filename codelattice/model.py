"""Schemas of the stored tables.

Text that has no value is the empty string, never NULL, once a table is loaded.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

SYMBOLS = _schema(
    id=_S, name=_S, kind=_S, file_path=_S, line=_I, end_line=_I, signature=_S, body_hash=_S, created_at=_L
)
CALLS = _schema(caller_id=_S, callee_id=_S, call_type=_S, file_path=_S, line=_I, created_at=_L)
MANIFEST = _schema(file_path=_S, file_hash=_S, last_indexed=_L)
VIRTUAL_NODES = _schema(
    id=_S, label=_S, type=_S, virtual_class_id=_S, virtual_directory=_S, materialized=_B, created_at=_L, updated_at=_L
)
NODE_ANNOTATIONS = _schema(
    node_id=_S, description=_S, ai_remarks=_S, code_snippet=_S, custom_properties=_S, created_at=_L, updated_at=_L
)
EDGE_ANNOTATIONS = _schema(
    edge_id=_S, source_node_id=_S, target_node_id=_S, remarks=_S, call_count=_I, created_at=_L, updated_at=_L
)
VIRTUAL_DIRECTORIES = _schema(id=_S, path=_S, name=_S, parent_path=_S, created_at=_L)
MASK_SESSIONS = _schema(
    id=_S, file_path=_S, original_code=_S, masked_code=_S, filled_code=_S, language=_S, status=_S,
    created_at=_L, updated_at=_L,
)

# A snapshot is kept as rows, one per node and one per edge, so that a snapshot of any size
# stays spread over the cluster. The nested JSON form exists only at the codec boundary.
SNAPSHOT_NODES = _schema(
    snapshot_id=_S, seq=_L, id=_S, label=_S, type=_S, file_path=_S, line=_I, is_virtual=_B, parent_id=_S,
    description=_S, ai_remarks=_S,
)
SNAPSHOT_EDGES = _schema(snapshot_id=_S, seq=_L, source_id=_S, target_id=_S, remarks=_S)

SNAPSHOT_NODE_JSON = _schema(
    id=_S, label=_S, type=_S, filePath=_S, line=_I, isVirtual=_B, parentId=_S, description=_S, aiRemarks=_S
)
SNAPSHOT_EDGE_JSON = _schema(id=_S, sourceId=_S, targetId=_S, remarks=_S)
