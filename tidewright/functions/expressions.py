"""Column expressions: closed-form lengths, ratios and formats. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_LEN = 46


def varint_len(x: Column) -> Column:
    """Bytes of an unsigned number as LEB128: one for each started seven bits."""
    out = F.when(x < 128, 1)
    for n in range(2, 10):
        out = out.when(x < F.lit(1 << (7 * n)), n) if 7 * n < 63 else out
    return out.otherwise(9)


def zigzag(x: Column) -> Column:
    return F.when(x >= 0, x * 2).otherwise(-x * 2 - 1)


def signed_len(x: Column) -> Column:
    return varint_len(zigzag(x))


def octets(text: Column) -> Column:
    """Bytes of a string in UTF-8."""
    return F.octet_length(text)


def string_len(text: Column) -> Column:
    """Bytes of a string with its length before it."""
    return varint_len(octets(text)) + octets(text)


def encoded_len(payload_len: Column) -> Column:
    return F.lit(HEADER_LEN) + payload_len


def ratio(output: Column, given: Column) -> Column:
    """output / given, 1 if nothing was given."""
    return F.when(given == 0, F.lit(1.0)).otherwise(output / given)


def saving_percent(output: Column, given: Column) -> Column:
    return F.round((F.lit(1.0) - ratio(output, given)) * 100, 4)


def reduction_percent(wire: Column, full: Column) -> Column:
    """As saving_percent, but 0 if nothing was sent."""
    return F.when(full == 0, F.lit(0.0)).otherwise(F.round((F.lit(1.0) - wire / full) * 100, 4))


def format_size(n: Column, space: str = " ") -> Column:
    """Bytes under a KiB as they are, else KiB to one place."""
    return F.when(n >= 1024, F.format_string(f"%.1f{space}KiB", F.bround(n / 1024.0, 1))).otherwise(F.format_string(f"%d{space}B", n))


def backpressure(local: Column, publisher: Column, max_lag: int = 10_000) -> Column:
    """accept, snapshot_and_catch_up or drop_client, by how far a client lags."""
    lag = F.greatest(publisher - local, F.lit(0))
    return F.when(local.isNull(), "snapshot_and_catch_up").when(lag <= max_lag, "accept").when(lag <= 10 * max_lag, "snapshot_and_catch_up").otherwise("drop_client")


def negotiated(min_version: Column, max_version: Column, own: int = 3) -> Column:
    """The publisher's only version if the client takes it, else null."""
    return F.when((min_version <= own) & (max_version >= own), F.lit(own))


def json_fields(pairs: list[tuple[str, Column]]) -> Column:
    """Compact JSON of fields whose values are JSON already; null values' fields are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in pairs)), F.lit("}"))


def quoted(text: Column) -> Column:
    """A JSON string of a text without control characters."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
