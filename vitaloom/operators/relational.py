"""Tenant-scoped reads: filters, semi-joins, pages, scopes, and latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, owner_col: str, owner: object) -> DataFrame:
    """The way into every table: rows of one owner."""
    return df.where(F.col(owner_col) == F.lit(owner))


def in_scope(df: DataFrame, id_col: str, ids: Sequence | None) -> DataFrame:
    """None: all rows; a list: its rows; an empty list: none, and nothing is read."""
    if ids is None:
        return df
    return df.where(F.col(id_col).isin(*ids)) if ids else df.limit(0)


def shared_scope(df: DataFrame, id_col: str, ids: Sequence) -> DataFrame:
    """Scope of a share: here an empty list means the whole record."""
    return df.where(F.col(id_col).isin(*ids)) if ids else df


def owned(requested: DataFrame, records: DataFrame, id_col: str) -> DataFrame:
    """Requested ids that the owner has."""
    return requested.join(records.select(id_col), id_col, "left_semi")


def optional_filters(df: DataFrame, equal: dict[str, object] | None = None, at_least: tuple[str, object] | None = None, at_most: tuple[str, object] | None = None) -> DataFrame:
    """Conjunction of those filters that are given; a null date passes no bound."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    for bound, test in ((at_least, Column.__ge__), (at_most, Column.__le__)):
        if bound and bound[1] is not None:
            df = df.where(test(F.col(bound[0]), F.lit(bound[1]).cast("timestamp_ntz")))
    return df


def containing(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Case-blind substring in any of the columns; wildcards in the needle are literal."""
    test = F.lit(False)
    for c in columns:
        test |= F.contains(F.lower(F.col(c)), F.lit(needle.lower()))
    return df.where(test)


def having(df: DataFrame, details: DataFrame, on: str, detail_on: str, test: Column) -> DataFrame:
    """Rows with a detail row that passes; the equality stays outside the test, so it is a hash semi-join."""
    return df.join(details.where(test).select(F.col(detail_on).alias("_k")), F.col(on) == F.col("_k"), "left_semi")


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_first(*columns: str, ties: str) -> list[Column]:
    """Descending with unknown values first, then by id."""
    return [*(F.col(c).desc_nulls_first() for c in columns), F.col(ties).asc()]


def capped(df: DataFrame, order: Sequence[Column], cap: int, by: str | None = None) -> DataFrame:
    """First ``cap`` rows, of the table or of each owner."""
    if by is None:
        return df.orderBy(*order).limit(cap)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int | None = None, owner: str | None = None) -> DataFrame:
    """Newest row of each key, among the newest ``cap`` rows of an owner if a cap is given (the cap comes first)."""
    df = capped(df, order, cap, owner) if cap else df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def month_timeline(df: DataFrame, owner: str, day: str, *event: str) -> DataFrame:
    """Events by month, newest first inside: owner, month, n, events."""
    month = F.date_format(day, "yyyy-MM")
    events = F.sort_array(F.collect_list(F.struct(day, *event)), asc=False)
    return df.groupBy(owner, month.alias("month")).agg(F.count("*").alias("n"), events.alias("events"))


def conversation_rollup(turns: DataFrame, conv: str, at: str, role: str, text: str) -> DataFrame:
    """Last turn, number of turns, and as title the least of the user's texts, cut to 80 characters."""
    title = F.min(F.when(F.col(role) == "user", F.left(F.col(text), F.lit(80))))
    return turns.groupBy(conv).agg(F.max(at).alias("last_at"), F.count("*").alias("messages"), title.alias("title"))


def last_turns(turns: DataFrame, conv: str, at: str, n: int, role: str = "role", roles: Sequence[str] = ("user", "assistant")) -> DataFrame:
    """Newest ``n`` turns of each conversation that a user or assistant said."""
    w = Window.partitionBy(conv).orderBy(F.desc(at))
    return turns.where(F.col(role).isin(*roles)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def fingerprint(df: DataFrame, owner: str, changed: str) -> DataFrame:
    """Row count and last change of an owner as one string."""
    stamp = F.coalesce(F.date_format(F.max(changed), "yyyy-MM-dd HH:mm:ss"), F.lit("none"))
    return df.groupBy(owner).agg(F.concat(F.count("*").cast("string"), F.lit(":"), stamp).alias("fingerprint"))


def without_repeated_last(turns: DataFrame, conv: str, at: str, role: str, text: str, said: str) -> DataFrame:
    """Turns without a newest user turn that only repeats what has just been said."""
    last = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(at))) == 1
    return turns.withColumn("_last", last).where(~(F.col("_last") & (F.col(role) == "user") & (F.col(text) == F.lit(said)))).drop("_last")


def listing(df: DataFrame, owner: str, order: Sequence[Column], cap: int | None = None) -> DataFrame:
    """Each owner's rows with their ``place`` in the list, the first ``cap`` of them."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))
    return placed if cap is None else placed.where(F.col("place") <= cap)


def counted_in(df: DataFrame, keys: Sequence[str], col: str, values: Sequence[str]) -> DataFrame:
    """How many rows of each key have one of the values."""
    return df.where(F.col(col).isin(*values)).groupBy(*keys).agg(F.count("*").alias("n"))
