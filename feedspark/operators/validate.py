"""Record validation: JSON records against the fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.binding import let

# The required text fields of each record, and its required list.
REQUIRED = {
    "feed": (["id", "title", "updated"], "entries", ["id", "title", "link"]),
    "mesh": (["name"], "sources", ["name", "url"]),
    "construct": (["name"], "meshes", None),
}


def _is_text(node: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(node, path, "variant")) == "STRING", F.lit(False))


def _is_list(node: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(node, path, "variant"))
    return F.coalesce(kind.startswith("ARRAY"), F.lit(False))


def problems(json: Column, kind: str) -> Column:
    """Reasons why a JSON text is not a valid record; empty when it is."""
    texts, items, item_texts = REQUIRED[kind]

    def check(node: Column) -> Column:
        found = [
            F.when(~_is_text(node, f"$.{name}"), F.lit(f"{name} is required")) for name in texts
        ]
        found.append(F.when(~_is_list(node, f"$.{items}"), F.lit(f"{items} must be a list")))
        listed = F.coalesce(F.try_variant_get(node, f"$.{items}", "array<variant>"), F.array())
        if item_texts:
            for name in item_texts:
                found.append(F.when(_lacking(listed, name), F.lit(f"{items}.{name} is required")))
        else:
            found.append(F.when(F.exists(listed, lambda e: ~_member(e)), F.lit("bad member")))
        return F.when(node.isNull(), F.array(F.lit("not JSON"))).otherwise(
            F.filter(F.array(*found), lambda r: r.isNotNull())
        )

    return let(F.try_parse_json(json), check)


def _lacking(listed: Column, name: str) -> Column:
    return F.exists(listed, lambda e: ~_is_text(e, f"$.{name}"))


def _member(node: Column) -> Column:
    """A name, a reference, or an inline mesh."""
    plain = F.coalesce(F.schema_of_variant(node) == "STRING", F.lit(False))
    mesh = _is_text(node, "$.name") & _is_list(node, "$.sources")
    return plain | _is_text(node, "$.ref") | mesh


def validate_records(records: DataFrame, json: str, kind: str, key: str) -> DataFrame:
    """Reject rows of invalid records."""
    return records.select(
        F.lit(kind).alias("stage"),
        F.col(key).alias("key"),
        F.explode(problems(F.col(json), kind)).alias("reason"),
    )
