"""Entries of transcripts as one wide table, and how readers make them from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of an entry besides its place (path, line, part) and time.
FIELDS = {
    "kind": "string", "role": "string", "reply_id": "string", "call_id": "string", "tool": "string", "name": "string", "text": "string", "input": "string", "label": "string",
    "searchable": "boolean", "model": "string", "input_tokens": "long", "output_tokens": "long", "cache_write": "long", "cache_read": "long",
}


def get(path: str, kind: str = "string", record: str | Column = "record") -> Column:
    return F.try_variant_get(F.col(record) if isinstance(record, str) else record, f"$.{path}", kind)


def text_of(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def entry(when: Column, **fields: Column | str) -> Column:
    """An entry where the condition holds, else null."""
    made = [(text_of(fields[f]) if f in fields else F.lit(None)).cast(t).alias(f) for f, t in FIELDS.items()]
    return F.when(when, F.struct(*made))


def filled(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def emit(rows: DataFrame, place: list[str], *found: Column) -> DataFrame:
    """The entries of each record, in this order; part counts them from 0. An array stands for its items."""
    arrays = [a if many else F.array(a) for a, many in ((x if isinstance(x, tuple) else (x, False)) for x in found)]
    entries = F.array_compact(F.concat(*arrays))
    return rows.select(*place, F.posexplode(entries).alias("part", "e")).select(*place, F.col("part").cast("long").alias("part"), "e.*")


def changed_models(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Entries without those that name the model again that was named last."""
    named = F.when(F.col("label") == "Model", F.col("text"))
    before = F.last(named, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return entries.withColumn("_before", before).where(F.coalesce(F.col("label") != "Model", F.lit(True)) | F.col("_before").isNull() | (F.col("_before") != F.col("text"))).drop("_before")


def millis(column: Column) -> Column:
    """Milliseconds as an RFC 3339 time."""
    return F.date_format(F.timestamp_millis(column), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def usage_total() -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_write", "cache_read")), F.lit(0))


def with_usage(entries: DataFrame) -> DataFrame:
    """Entries without the usages that count nothing."""
    return entries.where(F.coalesce(F.col("label") != "Usage", F.lit(True)) | (usage_total() > 0))


def renamed(text: Column, old: str, new: str) -> Column:
    """A JSON object's first key of a name renamed, where it is at the top of the object."""
    return F.when(F.get_json_object(text, f"$.{new}").isNull() & F.get_json_object(text, f"$.{old}").isNotNull(), F.regexp_replace(text, rf'^(\{{|\{{.*?,)\s*"{old}"\s*:', f'$1"{new}":')).otherwise(text)
