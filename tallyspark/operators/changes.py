"""Change audit, upsert and update on plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.ranking import Order, neighbours_by_bucket, with_neighbours


def _differs(old: Column, new: Column, missing: str | None) -> Column:
    """Plain ``<>`` (NULL on either side is no change) unless a stand-in for NULL is given."""
    if missing is None:
        return new != old
    return F.coalesce(new, F.lit(missing)) != F.coalesce(old, F.lit(missing))


def change_entries(fields: dict[str, str | None]) -> Column:
    """An array of one entry per field, from ``old`` and ``new`` image structs; ``changed`` is never NULL.

    ``fields`` maps a field to the text that stands for NULL in the
    comparison, or to None for plain ``<>``.
    """
    entries = []
    for name, missing in fields.items():
        old, new = F.col(f"old.{name}").cast("string"), F.col(f"new.{name}").cast("string")
        entries.append(
            F.struct(
                F.lit(name).alias("field_changed"),
                old.alias("old_value"),
                new.alias("new_value"),
                F.coalesce(_differs(old, new, missing), F.lit(False)).alias("changed"),
            )
        )
    return F.array(*entries)


def changed_fields(images: DataFrame, fields: dict[str, str | None], keep: Sequence[str]) -> DataFrame:
    """One row per changed field (see ``change_entries``) of rows holding ``old`` and ``new`` image structs.

    Rows are copied once per field, a number fixed by the caller.
    """
    changed = F.filter(change_entries(fields), lambda entry: entry["changed"])
    return images.select(*keep, F.explode(changed).alias("c")).select(
        *keep, "c.field_changed", "c.old_value", "c.new_value"
    )


def audit_update(
    before: DataFrame, after: DataFrame, key: str, fields: dict[str, str | None]
) -> DataFrame:
    """Changes between the old and the new version of a table, by key."""
    old = before.select(key, F.struct(*fields).alias("old"))
    new = after.select(key, F.struct(*fields).alias("new"))
    return changed_fields(new.join(old, key), fields, [key])


def audit_feed(
    feed: DataFrame,
    key: str,
    order: Order,
    fields: dict[str, str | None],
    keep: Sequence[str],
    bucket: Column | None = None,
) -> DataFrame:
    """Changes along a feed of row images: each image against the key's previous one.

    With ``bucket`` (see ``neighbours_by_bucket``; the order must then be
    ascending) images are paired a bucket at a time and nothing is written.
    """
    names = list(dict.fromkeys([key, *[name for name, _ in order], *keep]))
    images = feed.select(*names, F.struct(*fields).alias("new"))
    if bucket is not None:
        paired = neighbours_by_bucket(images, [key], bucket, [name for name, _ in order], "new", lag="old")
    else:
        paired = with_neighbours(images, [key], order, "new", "old", None)
    return changed_fields(paired.where(F.col("old").isNotNull()), fields, keep)


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of the same key; the others are kept or added."""
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(source.select(*target.columns))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE: an unknown condition leaves the row as it is."""
    return df.withColumns(
        {name: F.when(condition, value).otherwise(F.col(name)) for name, value in values.items()}
    )
