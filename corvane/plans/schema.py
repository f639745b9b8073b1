"""Declared schemas of the tables that the library keeps: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as t


def _struct(*fields: tuple[str, t.DataType]) -> t.StructType:
    return t.StructType([t.StructField(name, kind) for name, kind in fields])


_S, _L, _I, _D, _B, _T = t.StringType(), t.LongType(), t.IntegerType(), t.DoubleType(), t.BooleanType(), t.TimestampType()
VECTOR = t.ArrayType(t.FloatType(), containsNull=False)

SCHEMAS: dict[str, t.StructType] = {
    "people": _struct(("person_id", _L), ("family", _S), ("given", _S), ("full_name", _S), ("slug", _S), ("unit", _S), ("n_published", _L), ("n_current", _L), ("created_at", _T)),
    "items": _struct(
        ("item_id", _L), ("source", _S), ("ext_id", _S), ("urn", _S), ("title", _S), ("title_en", _S), ("abstract", _S), ("abstract_en", _S), ("keywords", t.ArrayType(_S)),
        ("field", _S), ("kind", _S), ("year", _I), ("programme", _S), ("track", _S), ("student", _S), ("embedding_text", _S), ("person_id", _L), ("created_at", _T),
    ),
    "item_vectors": _struct(("item_id", _L), ("model", _S), ("vector", VECTOR)),
    "roles": _struct(("item_id", _L), ("person_id", _L), ("role", _S)),
    "programmes": _struct(("programme_id", _L), ("level", _S), ("area", _S), ("code", _S), ("name", _S), ("name_en", _S), ("created_at", _T)),
    "courses": _struct(("course_id", _L), ("code", _S), ("name", _S), ("name_en", _S), ("credits", _D), ("holder", _S), ("outcomes", _S), ("syllabus", _S), ("embedding_text", _S), ("url", _S), ("created_at", _T)),
    "offerings": _struct(("course_id", _L), ("programme_id", _L), ("semester", _I), ("is_elective", _B), ("elective_group", _S)),
    "course_vectors": _struct(("course_id", _L), ("model", _S), ("vector", VECTOR)),
    "runs": _struct(("run_id", _S), ("source", _S), ("started_at", _T), ("finished_at", _T), ("status", _S), ("parsed", _L), ("upserted", _L), ("rejected", _L), ("warnings", t.ArrayType(_S)), ("error", _S)),
}
