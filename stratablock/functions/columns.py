"""Columns of block storage: keys, routing, addresses, checks, splices, names. Everything here is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digest algorithms by the index that a key's header carries, with digest lengths in bytes.
ALGORITHMS = {"MD5": (0, 16), "Tiger": (1, 24), "SHA-1": (2, 20), "SHA-256": (3, 32), "SHA-512": (4, 64)}
#: Block states of a layer.
NOT_ALLOCATED, ALLOCATED, TRIMMED = 0, 1, 2
#: Flags of a layer.
FLAG_ROOT, FLAG_PARTIAL, FLAG_BLOCKS = 1, 2, 4
#: Task states, and those that are final.
TASK_STATES = ("PENDING", "STARTED", "PREPARED", "COMMITTED", "ROLLED_BACK", "UNKNOWN")
DONE_STATES = ("COMMITTED", "ROLLED_BACK")
CLUSTER_SIZE = 4096
KEY_HEADER = 0x40


def _byte(hex_string: Column, i: Column) -> Column:
    return F.conv(F.substring(hex_string, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def xor_bytes(hex_string: Column) -> Column:
    """XOR of the bytes of a hex string: of words of four bytes first, then of the bytes of their XOR."""
    words = F.ceil(F.length(hex_string) / 8).cast("int")
    padded = F.lpad(hex_string, words * 8, F.lit("0"))
    word = lambda i: F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 16, 10).cast("long")

    def fold(x: Column) -> Column:
        x = x.bitwiseXOR(F.shiftright(x, 16))
        return x.bitwiseXOR(F.shiftright(x, 8)).bitwiseAND(F.lit(255)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(word(i)), fold)


def digest(algorithm: str, data: Column) -> Column:
    """Hex of the plain digest of binary data, lower case."""
    if algorithm == "MD5":
        return F.md5(data)
    if algorithm == "SHA-1":
        return F.sha1(data)
    if algorithm in ("SHA-256", "SHA-512"):
        return F.sha2(data, int(algorithm[4:]))
    from stratablock.functions.tiger import tiger_digest

    return F.lower(F.hex(tiger_digest(data)))


def persisted_key(digest_hex: Column, algorithm: str = "MD5") -> Column:
    """Hex of header, digest and XOR trailer, lower case."""
    head = f"{KEY_HEADER | ALGORITHMS[algorithm][0]:02x}"
    body = F.concat(F.lit(head), digest_hex)
    return F.concat(body, F.lower(F.lpad(F.hex(xor_bytes(body)), 2, "0")))


def key_algorithm(key: Column) -> Column:
    """Name of the algorithm in a key's header; null if the version bits or the index are unknown."""
    head = F.when(F.length(key) >= 2, _byte(key, F.lit(0)))
    found = F.lit(None).cast("string")
    for name, (index, _) in ALGORITHMS.items():
        found = F.when(head == (KEY_HEADER | index), F.lit(name)).otherwise(found)
    return found


def key_is_valid(key: Column) -> Column:
    """Version bits, algorithm, length and trailer of a persisted key (hex) all hold."""
    lengths = F.lit(-1)
    for name, (_, n) in ALGORITHMS.items():
        lengths = F.when(key_algorithm(key) == name, F.lit(2 * (n + 2))).otherwise(lengths)
    return F.coalesce(F.when(F.length(key) == lengths, xor_bytes(key) == 0), F.lit(False))


def key_matches(key: Column, data: Column) -> Column:
    """The digest that a key's header names, taken over data, is the key's (the algorithms the JVM has)."""
    found = F.lit(False)
    for name in ("MD5", "SHA-1", "SHA-256", "SHA-512"):
        found = F.when(key_algorithm(key) == name, key == persisted_key(digest(name, data), name)).otherwise(found)
    return found


def int_from_bytes(key: Column, at: int) -> Column:
    """Unsigned 32-bit little-endian integer of the four bytes of a hex string from byte `at` on."""
    pairs = [F.substring(key, 2 * (at + i) + 1, 2) for i in (3, 2, 1, 0)]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def partition_of(key: Column, partitions: int) -> Column:
    """Cold partition of a key: the four bytes before its middle as an unsigned integer, or the sum of a short key's bytes."""
    n = (F.length(key) / 2).cast("int")
    pairs = [F.substring(F.substring(key, ((n - 4) / 2).cast("int") * 2 + 1, F.lit(8)), 2 * i + 1, 2) for i in (3, 2, 1, 0)]
    wide = F.conv(F.concat(*pairs), 16, 10).cast("long")
    short = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda a, i: a + _byte(key, i))
    return F.pmod(F.when(n >= 4, wide).otherwise(short), F.lit(partitions)).cast("int")


def one_at_a_time(key: Column) -> Column:
    """Jenkins' one-at-a-time hash, 32 bits, of a hex string's bytes."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    n = (F.length(key) / 2).cast("int")

    def step(h: Column, i: Column) -> Column:
        h = (h + _byte(key, i)).bitwiseAND(mask)
        h = (h + F.shiftleft(h, 10)).bitwiseAND(mask)
        return h.bitwiseXOR(F.shiftright(h, 6))

    h = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), step)
    h = (h + F.shiftleft(h, 3)).bitwiseAND(mask)
    h = h.bitwiseXOR(F.shiftright(h, 11))
    return (h + F.shiftleft(h, 15)).bitwiseAND(mask)


def key_order(key: Column) -> list[Column]:
    """Sort columns: length first, then bytes as signed."""
    n = (F.length(key) / 2).cast("int")
    signed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(_byte(key, i) > 127, _byte(key, i) - 256).otherwise(_byte(key, i)))
    return [F.length(key), signed]


def l2_capacity(hash_size: Column | int, cluster: int = CLUSTER_SIZE) -> Column:
    """Records of a state byte and a key in one cluster."""
    return F.floor(F.lit(cluster) / (F.lit(hash_size) + 1)).cast("long")


def l1_offset(block_index: Column, capacity: Column) -> Column:
    return F.floor(block_index / capacity).cast("long")


def l2_index(block_index: Column, capacity: Column) -> Column:
    return (block_index % capacity).cast("long")


def h1_size(blocks: Column, capacity: Column) -> Column:
    return (8 + 8 * F.ceil(blocks / capacity)).cast("long")


def align_up(x: Column, unit: int) -> Column:
    return (F.ceil(x / unit) * unit).cast("long")


def size_is_valid(size: Column, block_size: int) -> Column:
    return (size == 0) | ((size >= block_size) & (size % block_size == 0))


def io_violation(offset: Column, length: Column, size: Column) -> Column:
    """Why a request is refused, or null; length 0 is accepted."""
    return (
        F.when(length < 0, "negative length").when(offset < 0, "negative offset")
        .when(offset + length > size, "beyond the device")
    )


def ranges_overlap(a_off: Column, a_len: Column, b_off: Column, b_len: Column) -> Column:
    return (a_off < b_off + b_len) & (b_off < a_off + a_len)


def zero_fill(data: Column, block_size: int) -> Column:
    """Data of a block, zeros where there is none."""
    return F.coalesce(data, F.lit(bytes(block_size)))


def splice(block: Column, patch: Column, at: Column) -> Column:
    """Block with patch over the bytes (or characters) from `at` on."""
    return F.overlay(block, patch, at + 1)


def flags_of(root: Column, partial: Column, blocks: Column) -> Column:
    return sum((F.when(c, F.lit(v)).otherwise(0) for c, v in ((root, FLAG_ROOT), (partial, FLAG_PARTIAL), (blocks, FLAG_BLOCKS))), F.lit(0))


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def write_delay(buffers: Column, threshold: int = 15, level: int = 5, step_ms: int = 10) -> Column:
    """Milliseconds by which a put waits while there are many generations."""
    return F.when(buffers > threshold, F.floor((buffers - threshold) / level) * step_ms).otherwise(0).cast("long")


def cache_size(ram: Column, partitions: int, least: int = 64 << 20, most: int = 1 << 30) -> Column:
    """Share of memory for a partition's cache; the number of partitions divides twice."""
    return F.greatest(F.least(F.floor(F.floor(ram / partitions) / partitions), F.lit(most)), F.lit(least)).cast("long")


def snapshot_name(device: Column, ts: Column) -> Column:
    return F.concat_ws(" ", device, F.date_format(ts, "yyyy-MM-dd'T'HH:mmZ"))


def free_percent(usable: Column, total: Column) -> Column:
    return F.floor(usable * 100 / total).cast("long")


def iscsi_name_is_valid(name: Column) -> Column:
    iqn = name.startswith("iqn.") & (F.octet_length(name) <= 233)
    return F.coalesce(iqn | name.rlike("^eui\\.[0-9A-Fa-f]{16}$"), F.lit(False))


def iscsi_alias_is_valid(alias: Column) -> Column:
    """At most 255 bytes of UTF-8, the last of which is 0 if there are 255; no alias is valid."""
    n = F.octet_length(alias)
    return alias.isNull() | (n < 255) | ((n == 255) & (F.hex(F.right(alias.cast("binary").cast("string"), F.lit(1))) == "00"))


def port_is_valid(port: Column) -> Column:
    return (port >= 1024) & (port <= 65535)


def is_quorum(online: Column, registered: Column) -> Column:
    """A strict majority of the registered nodes."""
    return online > F.floor(registered / 2)


def pairs_to_map(pairs: Column) -> Column:
    """Map from a flat list [k, v, k, v]; of equal keys the last counts, a key without a value is left out, null gives null."""
    # A list has few pairs; places are those of keys.
    places = F.transform(F.array_repeat(F.lit(0), F.floor(F.size(pairs) / 2).cast("int")), lambda _, i: 2 * i + 1)
    is_last = lambda i: ~F.exists(F.filter(places, lambda j: j > i), lambda j: F.element_at(pairs, j) == F.element_at(pairs, i))
    entries = F.transform(F.filter(places, is_last), lambda i: F.struct(F.element_at(pairs, i).alias("key"), F.element_at(pairs, i + 1).alias("value")))
    return F.when(pairs.isNotNull(), F.map_from_entries(entries))


def join_list(items: Column) -> Column:
    """Paths or peers as one text, separated by commas; null items are left out."""
    return F.array_join(items, ",")


def split_list(text: Column) -> Column:
    """The items of a text that join_list made: none of an empty or null text, and no empty one after a last comma."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, ",$", ""), ","))


def resource_json(*fields: Column) -> Column:
    """A resource as JSON without a root element; null fields are left out."""
    return F.to_json(F.struct(*fields))


def path_of(key: Column, deep: bool = True) -> Column:
    """File of a key: flat, or below two levels of prefix folders."""
    return F.concat_ws("/", F.substring(key, 1, 2), F.substring(key, 3, 2), key) if deep else key
