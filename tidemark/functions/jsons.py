"""JSON text, map and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import names

# Keys of a job summary that an event may not change.
PROTECTED_KEYS = (
    "canonical_intent", "canonical_intent_schema_version", "canonical_intent_status",
    "intent_id", "intent_revision", "intent_hash", "parent_intent_id", "grounded_at",
    "capability_version", "intent_extractor_version", "intent_normalizer_version",
    "intent_grounding_version", "intent_created_at", "original_instruction",
    "data_profile", "profile_status", "file_fingerprint", "profiler_version",
)
ROW_KEYS = ("records", "rows", "data")


def field(c: Column, name: str) -> Column:
    """One top-level field of a JSON text as text, empty when absent."""
    return F.coalesce(F.get_json_object(c, f"$.{name}"), F.lit(""))


def as_map(c: Column) -> Column:
    """A JSON object as a map of its fields' texts; unreadable text gives null."""
    return F.from_json(c, "map<string,string>")


def merge_protected(old: Column, new: Column, protected: tuple[str, ...] = PROTECTED_KEYS) -> Column:
    """Fields of ``new`` over those of ``old``, except that protected fields keep the old value."""
    old = F.coalesce(old, F.create_map().cast("map<string,string>"))
    incoming = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, _v: ~k.isin(*protected))
    kept = F.map_filter(old, lambda k, _v: ~F.map_contains_key(incoming, k))
    return F.map_concat(kept, incoming)


def stable_text(m: Column, volatile: tuple[str, ...] = ()) -> Column:
    """A map as ``key=value`` lines in key order, without the volatile keys."""
    kept = F.map_filter(m, lambda k, _v: ~k.isin(*volatile)) if volatile else m
    pairs = F.array_sort(F.map_entries(kept))
    return F.array_join(
        F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "\n"
    )


def stable_hash(m: Column, volatile: tuple[str, ...] = ()) -> Column:
    """SHA-256 that does not depend on the order of the fields, and differs for different objects: keys and
    values are quoted as JSON, and a null value is left out of its entry."""
    kept = F.map_filter(m, lambda k, _v: ~k.isin(*volatile)) if volatile else m
    return F.sha2(F.to_json(F.array_sort(F.map_entries(kept))), 256)


def first_with(items: Column, key: str, value: str) -> Column:
    """First struct of an array whose field equals a text, case and outer blanks ignored."""
    return F.try_element_at(F.filter(items, lambda e: F.lower(F.trim(e[key])) == value.lower()), F.lit(1))


def agent_summary(c: Column, agent: str) -> Column:
    """The text of an agent's summary in a JSON document: the first non-empty ``summary`` or, failing
    that, ``bullets`` entry of that agent, white space collapsed, without a final full stop."""
    entries = F.from_json(
        F.get_json_object(c, "$.agent_summaries"), "array<struct<agent_id:string,summary:string,bullets:array<string>>>"
    )
    own = F.filter(entries, lambda e: F.lower(F.trim(e["agent_id"])) == agent)
    clean = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    texts = F.flatten(
        F.transform(own, lambda e: F.concat(F.array(e["summary"]), F.coalesce(e["bullets"], F.array().cast("array<string>"))))
    )
    found = F.filter(F.transform(texts, clean), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.coalesce(F.regexp_replace(F.try_element_at(found, F.lit(1)), r"\.$", ""), F.lit(""))


def reconcile_status(code: Column, payload_status: Column, errors: Column, error: Column | None = None) -> Column:
    """The status of an event from its code, the status inside its payload and its error list.

    ``errors`` is an array of texts; ``error`` a single text. A success with any non-blank error is
    a failure; then the payload's own status decides; unknown codes give null.
    """
    c, p = F.lower(F.trim(code)), F.lower(F.trim(payload_status))
    mapped = (
        F.when(c.isin("complete", "completed", "succeeded"), "succeeded")
        .when(c.isin("failed", "partial"), "failed")
        .when(
            c.isin(
                "queued", "planning", "running", "quarantined", "callback_failed", "awaiting_schema_approval",
                "awaiting_confirmation", "declined", "awaiting_clarification",
            ),
            c,
        )
    )
    listed = F.exists(F.coalesce(errors, F.array().cast("array<string>")), lambda e: F.coalesce(F.trim(e), F.lit("")) != "")
    single = F.lit(False) if error is None else F.coalesce(F.trim(error), F.lit("")) != ""
    return (
        F.when(mapped.isNull(), F.lit(None).cast("string"))
        .when((mapped == "succeeded") & (listed | single), "failed")
        .when(p.isin("failed", "partial"), "failed")
        .when(p == "quarantined", "quarantined")
        .when(p.isin("complete", "completed", "succeeded"), "succeeded")
        .otherwise(mapped)
    )


def with_payload_rows(df: DataFrame, payload: str, name: str = "rows") -> DataFrame:
    """Add the array of row objects (as maps) a result payload holds, by precedence:
    ``cleaned_data``, ``cleaned_preview`` unless it is shorter than ``record_count``, ``records``,
    ``rows``, ``data``.

    A list only counts when it is not empty and all of its items are objects. Keys starting with an
    underscore are removed, and rows left empty with them. The payload is parsed once, in a
    projection of its own.
    """
    kind = "array<map<string,string>>"
    lists = ("cleaned_data", "cleaned_preview", *ROW_KEYS)
    fields = ", ".join([f"{k} {kind}" for k in lists] + ["record_count string"])
    parsed = df.withColumn("__p", F.from_json(F.col(payload), fields))

    def usable(key: str) -> Column:
        items = F.col(f"__p.{key}")
        return F.when((F.size(items) > 0) & F.forall(items, lambda i: i.isNotNull()), items)

    preview, none = usable("cleaned_preview"), F.array().cast(kind)
    expected = F.coalesce(F.col("__p.record_count").try_cast("int"), F.lit(0))
    cut = (expected != 0) & (expected > F.size("__p.cleaned_preview"))
    chosen = F.coalesce(
        usable("cleaned_data"), F.when(preview.isNotNull() & cut, none), preview, *[usable(k) for k in ROW_KEYS], none
    )
    visible = F.transform(chosen, lambda r: F.map_filter(r, lambda k, _v: ~F.startswith(k, F.lit("_"))))
    return parsed.withColumn(name, F.filter(visible, lambda r: F.size(r) > 0)).drop("__p")


def explode_payload_rows(df: DataFrame, payload: str, position: str = "pos", row: str = "row") -> DataFrame:
    """One output row per row object of the payload.

    The outer form is exploded and its empty results are filtered afterwards: for the inner form
    Spark adds a test of the array below the explode, which would parse every payload again.
    """
    kept = [names.col(c) for c in df.columns]
    rows = with_payload_rows(df, payload, "__rows").select(*kept, F.posexplode_outer("__rows").alias(position, row))
    return rows.filter(F.col(position).isNotNull())


def typed_rows(df: DataFrame, payload: str, schema: T.StructType | str, order_by: list[str]) -> DataFrame:
    """A table from stored JSON rows, in stored order; empty payloads are left out."""
    parsed = df.filter(F.coalesce(F.trim(payload), F.lit("")) != "").filter(F.trim(payload) != "{}")
    return parsed.orderBy(*order_by).select(F.from_json(F.col(payload), schema).alias("__r")).select("__r.*")
