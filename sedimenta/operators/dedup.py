"""Deduplication and identity over typed columns: first wins, key validity, duplicate profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.errors import DeduplicationError
from sedimenta.functions.paths import parse_path
from sedimenta.functions.values import is_blank
from sedimenta.session import free_name

#: Fixed value: most distinct keys one run may hold.
MAX_UNIQUE_KEYS = 50_000_000


def resolve_primary_key(value: str | Sequence[str] | None) -> tuple[str, ...]:
    """Key paths in order, repeats dropped; each must be a valid path."""
    if value is None:
        return ()
    if isinstance(value, bool) or not isinstance(value, (str, list, tuple)):
        raise TypeError("primary_key is a path or a sequence of paths")
    paths = [value] if isinstance(value, str) else list(value)
    for p in paths:
        if not isinstance(p, str):
            raise TypeError("primary_key holds paths only")
        parse_path(p)
    if not paths:
        raise ValueError("primary_key is empty")
    return tuple(dict.fromkeys(paths))


def valid_key(df: DataFrame, keys: Sequence[str]) -> Column:
    """Every key is there: non-null, a scalar, and for texts not blank."""
    ok = F.lit(True)
    for k in keys:
        kind = df.schema[k].dataType
        col = F.col(f"`{k}`")
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.lit(False)
        ok = ok & col.isNotNull() & (~is_blank(col) if isinstance(kind, T.StringType) else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def canonical_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """JSON text of a row: columns in name order, nulls kept."""
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})


def row_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.sha2(canonical_row(df, columns), 256)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], strict: bool = True, salts: int = 0) -> DataFrame:
    """The first row of each key by ``order`` (which must be total for a repeatable choice; a struct compare, nulls
    first). An invalid key fails the job in strict mode; otherwise such rows are dropped.

    With ``salts`` rows first collapse within (key, salt), so that a key with a third of all rows is
    spread over that many tasks before its survivors meet."""
    ok = valid_key(df, keys)
    if strict:
        gate = free_name(df.columns, "__gate")
        checked = df.withColumn(gate, F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("InvalidDeduplicationKeyError: a record has no valid primary key")).cast("boolean"))).filter(F.col(gate)).drop(gate)
    else:
        checked = df.filter(ok)
    rank = free_name(df.columns, "__rank")
    sort = [F.col(f"`{o}`") for o in order]
    if salts > 1:
        salt = free_name(df.columns, "__salt")
        checked = checked.withColumn(salt, F.pmod(F.xxhash64(*sort), F.lit(salts)))
        by = Window.partitionBy(*[f"`{k}`" for k in keys], salt).orderBy(*sort)
        checked = checked.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) == 1).drop(rank, salt)
    by = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(*sort)
    return checked.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) == 1).drop(rank)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Complete rows once each (all copies are equal, so any may stay)."""
    return df.dropDuplicates()


def duplicate_profile(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: records, duplicate_rows, invalid_key_rows, unique_rows, key_complete, key_unique,
    mode. Without keys whole rows are compared. Keys are counted once by a partial aggregate, so a
    hot key costs one group."""
    if keys:
        ok = valid_key(df, keys)
        per_key = df.groupBy(*[F.when(ok, F.col(f"`{k}`")).alias(f"k{i}") for i, k in enumerate(keys)], ok.alias("ok")).agg(F.count("*").alias("n"))
    else:
        per_key = df.groupBy(row_fingerprint(df).alias("k0")).agg(F.count("*").alias("n")).withColumn("ok", F.lit(True))
    total = F.coalesce(F.sum("n"), F.lit(0))
    out = per_key.agg(total.alias("records"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("invalid_key_rows"))
    return out.select(
        "records", "duplicate_rows", "invalid_key_rows",
        (F.col("records") - F.col("duplicate_rows") - F.col("invalid_key_rows")).alias("unique_rows"),
        (F.col("invalid_key_rows") == 0).alias("key_complete"),
        ((F.col("invalid_key_rows") == 0) & (F.col("duplicate_rows") == 0)).alias("key_unique"),
        F.lit("key" if keys else "row").alias("mode"),
    )


def assert_key_limit(df: DataFrame, keys: Sequence[str], limit: int = MAX_UNIQUE_KEYS) -> int:
    """Number of distinct valid keys; DeduplicationError above ``limit``."""
    n = df.filter(valid_key(df, keys)).select(*[F.col(f"`{k}`") for k in keys]).distinct().count()
    if n > limit:
        raise DeduplicationError(f"{n} distinct keys exceed the limit of {limit}")
    return n
