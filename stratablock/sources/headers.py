"""Layer headers: 104 bytes, big-endian, as hex. Decoding and encoding are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratablock.functions.columns import FLAG_PARTIAL, FLAG_ROOT, flags_of, has_flag, h1_size, l2_capacity

#: The magic of a header, and its fields in order with their lengths in bytes.
MAGIC = "4e525331"
FIELDS = (("parent", 16), ("device", 16), ("node", 16), ("file", 16), ("size", 8), ("block_size", 4), ("cluster_size", 4), ("hash_size", 4), ("h1", 4), ("ts", 8), ("flags", 4))
LENGTH = 104


def encode_header(rows: DataFrame) -> DataFrame:
    """rows with header: hex of the fields; ids are UUID strings, flags come from is_root, is_partial and has_blocks."""
    parts = [F.lit(MAGIC)]
    for name, n in FIELDS:
        if n == 16:
            parts.append(F.regexp_replace(name, "-", ""))
        else:
            value = flags_of(F.col("is_root"), F.col("is_partial"), F.col("has_blocks")) if name == "flags" else F.col(name)
            # Negative numbers have 16 digits already; the last 2 n of them are theirs.
            parts.append(F.right(F.lpad(F.lower(F.hex(value.cast("long"))), 16, "0"), F.lit(2 * n)))
    return rows.withColumn("header", F.concat(*parts))


def _number(hex_digits: Column, n: int) -> Column:
    """Signed number of n bytes."""
    if n == 8:
        high, low = (F.conv(F.substring(hex_digits, a, 8), 16, 10).cast("long") for a in (1, 9))
        signed = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high)
        return signed * F.lit(1 << 32) + low
    value = F.conv(hex_digits, 16, 10).cast("long")
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def decode_header(rows: DataFrame, header: str = "header") -> DataFrame:
    """rows with the fields of a header and `error`: null, TOO_SHORT or BAD_MAGIC (then all fields are null)."""
    error = F.when(F.length(header) < 2 * LENGTH, "TOO_SHORT").when(F.substring(F.col(header), 1, 8) != MAGIC, "BAD_MAGIC")
    out, at = rows.withColumn("error", error), 9
    for name, n in FIELDS:
        digits = F.substring(F.col(header), at, 2 * n)
        at += 2 * n
        cut = [F.substring(digits, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        value = F.concat_ws("-", *cut) if n == 16 else _number(digits, n)
        out = out.withColumn(name, F.when(F.col("error").isNull(), value))
    return out.withColumns({"is_root": has_flag(F.col("flags"), FLAG_ROOT), "is_partial": has_flag(F.col("flags"), FLAG_PARTIAL)})


def header_faults(rows: DataFrame) -> DataFrame:
    """rows with fault: the first sanity rule that a decoded header breaks, or null."""
    blocks = F.floor(F.col("size") / F.col("block_size"))
    fault = (
        F.when(F.col("block_size") <= 0, "block size").when(F.col("size") < 0, "negative size")
        .when(F.col("size") % F.col("block_size") != 0, "size is not whole blocks").when(F.col("hash_size") <= 0, "hash size")
        .when(F.col("cluster_size") < F.col("hash_size"), "cluster size").when(F.col("h1") < LENGTH, "table address")
    )
    capacity = l2_capacity(F.col("hash_size"))
    return rows.withColumns({"fault": fault, "blocks": blocks, "h1_bytes": h1_size(blocks, capacity)})


#: How recordings and hot buffers begin, and the version of hot buffers.
RECORDING, BUFFER, BUFFER_VERSION = "IBSR", "REFDB", 1


def file_kind(data: Column) -> Column:
    """recording, buffer (of the known version, 8 bytes big-endian after its magic), layer or unknown, by a file's first bytes."""
    start = F.hex(F.substring(data, 1, LENGTH))
    buffer = BUFFER.encode().hex().upper() + f"{BUFFER_VERSION:016X}"
    return F.when(start.startswith(RECORDING.encode().hex().upper()), "recording").when(start.startswith(buffer), "buffer").when(start.startswith(MAGIC.upper()), "layer").otherwise("unknown")
