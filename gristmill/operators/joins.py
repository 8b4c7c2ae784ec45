"""Joins with the engine's key rules: a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.columns import ROW_ID, qcol, visible


def _right_side(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, str]:
    """The right table with its key named apart and clashing columns marked ``__right``."""
    key = "__join_key"
    taken = set(left.columns)
    columns = [qcol(right_key).alias(key)]
    for c in visible(right):
        if c == right_key and left_key == right_key:
            continue
        columns.append(qcol(c).alias(f"{c}__right" if c in taken else c))
    return right.select(*columns), key


def left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left outer join on one pair of columns, null equal to null. Equal key names leave one column."""
    other, key = _right_side(left, right, left_key, right_key)
    return left.join(other, qcol(left_key).eqNullSafe(F.col(key)), "left").drop(key)


def inner_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    other, key = _right_side(left, right, left_key, right_key)
    return left.join(other, qcol(left_key).eqNullSafe(F.col(key)), "inner").drop(key)


def semi_join(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose value is among the keys; missing values are in no list."""
    return df.join(keys.select(qcol(key).alias("__key")), qcol(column) == F.col("__key"), "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose value is not among the keys; a missing value stays."""
    return df.join(keys.select(qcol(key).alias("__key")), qcol(column) == F.col("__key"), "left_anti")


def upsert_by_source(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """``old`` without the rows of the sources in ``new``, and ``new``."""
    return anti_join(old, new.select(qcol(source)).distinct(), source, source).unionByName(new, allowMissingColumns=True)


def compare_snapshots(left: DataFrame, right: DataFrame, key: str, measures: Sequence[str], left_label: str = "left", right_label: str = "right", right_key: str | None = None) -> DataFrame:
    """Measures of two tables summed by key and set side by side.

    Gives each measure of either side (0 where the side lacks the key), ``<m>_delta`` and
    ``<m>_pct`` (null where the left is 0), and STATUS: both, new (right side only) or
    gone. Text measures are read as numbers before they are summed. The row without a
    key on one side meets that of the other.
    """

    def summed(df: DataFrame, k: str, label: str) -> DataFrame:
        sums = [F.coalesce(F.sum(qcol(m).try_cast("double")), F.lit(0.0)).alias(f"{m}_{label}") for m in measures]
        return df.groupBy(qcol(k).alias(f"__{label}")).agg(*sums, F.lit(True).alias(f"__has_{label}"))

    a, b = summed(left, key, left_label), summed(right, right_key or key, right_label)
    both = a.join(b, F.col(f"`__{left_label}`").eqNullSafe(F.col(f"`__{right_label}`")), "full_outer")
    out = [F.coalesce(qcol(f"__{left_label}"), qcol(f"__{right_label}")).alias(key)]
    for m in measures:
        x, y = F.coalesce(qcol(f"{m}_{left_label}"), F.lit(0.0)), F.coalesce(qcol(f"{m}_{right_label}"), F.lit(0.0))
        out += [x.alias(f"{m}_{left_label}"), y.alias(f"{m}_{right_label}"), (y - x).alias(f"{m}_delta"), F.bround(F.try_divide(F.lit(100.0) * (y - x), x), 2).alias(f"{m}_pct")]
    has_left, has_right = (F.coalesce(qcol(f"__has_{s}"), F.lit(False)) for s in (left_label, right_label))
    return both.select(*out, F.when(has_left & has_right, "both").when(has_right, "new").otherwise("gone").alias("STATUS"))


def code_lookup(df: DataFrame, mapping: DataFrame, code: str, mapping_code: str, mapping_name: str, alias: str = "name") -> DataFrame:
    """The first name of each row's code in the mapping's order, upper-cased and trimmed on both sides."""
    clean = lambda c: F.upper(F.trim(qcol(c).cast("string")))
    order = F.col(ROW_ID) if ROW_ID in mapping.columns else qcol(mapping_name)
    first = mapping.where(qcol(mapping_name).isNotNull()).groupBy(clean(mapping_code).alias("__code")).agg(F.min_by(qcol(mapping_name), order).alias(alias))
    return df.withColumn("__c", clean(code)).join(first, F.col("__c") == F.col("__code"), "left").drop("__c", "__code")


def set_intersect(left: DataFrame, right: DataFrame, left_column: str, right_column: str) -> DataFrame:
    """Distinct values, upper-cased and trimmed, that both columns have."""
    clean = lambda df, c: df.select(F.upper(F.trim(qcol(c).cast("string"))).alias("value")).where("value is not null and value <> ''")
    return clean(left, left_column).intersect(clean(right, right_column))


