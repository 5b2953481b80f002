"""Tag hashes as built-in expressions: the name-based UUID (version 5) and the older CRC form."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The URL namespace of RFC 9562, and the salt of the older form.
NAMESPACE_URL = uuid.NAMESPACE_URL.hex
CRC_SALT = bytes([0x9E, 0x37, 0x79, 0xB9])


def tag_hash_v5(tag: Column) -> Column:
    """32 hex digits of UUIDv5(URL, tag); null for a null tag."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(tag, "UTF-8"))), 1, 32)
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.lower(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), F.hex(variant), F.substring(digest, 18, 15)))


def tag_hash_crc(tag: Column) -> Column:
    """32 hex digits of the older form: two CRC32 sums, of the tag and of the tag with a salt behind it.

    They make one 64-bit number, written low byte first and padded with zeros.
    """
    data = F.encode(tag, "UTF-8")
    high, low = F.crc32(data), F.crc32(F.concat(data, F.lit(bytearray(CRC_SALT))))
    digits = F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0"))
    pairs = [F.substring(digits, i, 2) for i in range(15, 0, -2)]
    return F.lower(F.concat(*pairs, F.lit("0" * 16)))
