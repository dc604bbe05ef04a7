"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_millis(ts) -> Column:
    """Epoch milliseconds of a wall-clock (``timestamp_ntz``) value, floored.

    ``timestampdiff`` on two NTZ values does not depend on the session time
    zone, unlike ``unix_millis(cast(ts as timestamp))``.
    """
    return F.expr(f"timestampdiff(MILLISECOND, {_EPOCH_NTZ}, {_sql(ts)})")


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name")


def day_int(ts) -> Column:
    """``yyyymmdd`` as an int, from a timestamp/date column (no string formatting)."""
    t = _c(ts)
    return F.year(t) * 10000 + F.month(t) * 100 + F.dayofmonth(t)


def millis_to_date(ms, tz: str = "UTC", fmt: str = "yyyy-MM-dd") -> Column:
    """``from_unixtime(ms/1000, fmt)`` with an explicit zone (G1).

    The instant is moved to wall-clock time in ``tz`` first, so the result does
    not change with ``spark.sql.session.timeZone``.
    """
    wall = F.convert_timezone(None, F.lit(tz), F.timestamp_millis(_c(ms)))
    return F.date_format(wall, fmt)


def hash_u32(*parts) -> Column:
    """First 32 bits of ``md5(concat_ws(':', parts))`` as a non-negative long.

    DuckDB: ``('0x' || substr(md5(...), 1, 8))::BIGINT`` gives the same value.
    """
    key = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_unit(*parts) -> Column:
    """A deterministic uniform draw in [0, 1) from md5 of the parts."""
    return hash_u32(*parts) / F.lit(4294967296.0)


def flag(c, true_value: str) -> Column:
    """Text flag to 0/1 (``yes`` / ``True.``) as an int."""
    return F.when(_c(c) == F.lit(true_value), 1).otherwise(0)


def euclidean(a, b) -> Column:
    """Euclidean norm of ``a - b`` for two equal-length numeric arrays."""
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def round_sig(c, digits: int = 12) -> Column:
    """Round a double to ``digits`` significant digits.

    Goes through ``%.{digits-1}e`` text, so the result does not depend on how
    the engine rounds binary fractions; used where two engines sum doubles in
    different orders and the last bits differ.
    """
    return F.format_string(f"%.{digits - 1}e", _c(c)).cast("double")
