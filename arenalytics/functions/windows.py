"""Time predicates and interval measures shared by the session operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, AFK = "session_start", "session_end", "afk_time"


def _l(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")


def overlap(a, b) -> Column:
    return (F.col(END) >= _l(a)) & (F.col(START) <= _l(b))


def start_in(a, b) -> Column:
    return (F.col(START) >= _l(a)) & (F.col(START) < _l(b))


def contained(a, b) -> Column:
    return (F.col(END) <= _l(b)) & (F.col(START) >= _l(a))


def after_until(column: str, a, b) -> Column:
    """``(a, b]``, the window for dated rows."""
    return (F.col(column) > _l(a)) & (F.col(column) <= _l(b))


def closed(column: str, a, b) -> Column:
    return F.col(column).between(_l(a), _l(b))


def half_open(column: str, a, b) -> Column:
    return (F.col(column) >= _l(a)) & (F.col(column) < _l(b))


def strictly_inside(column: str, a, b) -> Column:
    return (F.col(column) > _l(a)) & (F.col(column) < _l(b))


def clipped(a, b) -> Column:
    return F.least(F.col(END), _l(b)) - F.greatest(F.col(START), _l(a))


def length() -> Column:
    return F.col(END) - F.col(START)


def active() -> Column:
    return F.col(END) - F.col(START) - F.col(AFK)


def valid_ping(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (c > 0) & (c <= 4000)


def scope(df: DataFrame, servers=None, column: str = "server_id") -> DataFrame:
    """Keep rows of the given servers; None or an empty list means every server.

    ``servers`` is a list of ids or a DataFrame with a ``server_id`` column.
    """
    if isinstance(servers, DataFrame):
        wanted = servers.select(F.col("server_id").alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    ids = list(servers) if servers is not None else []
    return df.where(F.col(column).isin(ids)) if ids else df


def restrict(df: DataFrame, users: DataFrame | Iterable[int] | None, column: str = "user_id") -> DataFrame:
    """Keep rows of a user set given as ids or as a one-column DataFrame."""
    if users is None:
        return df
    if isinstance(users, DataFrame):
        wanted = users.select(F.col(users.columns[0]).alias(column))
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(list(users)))
