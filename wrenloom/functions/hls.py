"""Scalar functions on playlist tags and encrypted segments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenloom.functions import urls


def bandwidth(line: Column) -> Column:
    """The BANDWIDTH attribute of a variant's tag as an integer; AVERAGE-BANDWIDTH is another one. 0 for a missing or malformed one."""
    text = F.regexp_extract(line, r"(?:^|[:,])BANDWIDTH=([^,]*)", 1)
    return F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def tag_uri(tag: Column, base: Column) -> Column:
    """The quoted URI attribute of a tag, resolved; null without one."""
    uri = F.when(tag.rlike('URI="[^"]*"'), F.regexp_extract(tag, 'URI="([^"]*)"', 1))
    return urls.resolve(uri, base)


def tag_iv(tag: Column) -> Column:
    """The IV attribute of a key tag as it stands there, empty without one."""
    return F.regexp_extract(tag, r"IV=([^, \t\r\n]*)", 1)


def iv_bytes(text: Column) -> Column:
    """Bytes of a hexadecimal IV: a leading 0x is dropped, an odd length gets a zero in front. Null if it isn't hexadecimal."""
    digits = F.regexp_replace(text, "^0x", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits))


def implicit_iv(index: Column) -> Column:
    """The IV of a segment whose key names none: its number, in 16 bytes."""
    return F.unhex(F.lpad(F.hex(index.cast("bigint")), 32, "0"))


def byte_range(text: Column) -> Column:
    """struct(length, offset) of "length@offset"; without an offset that is null. Null for anything else."""
    length, offset = F.regexp_extract(text, r"^(\d{1,18})(?:@\d{1,18})?$", 1), F.regexp_extract(text, r"^\d{1,18}@(\d{1,18})$", 1)
    return F.when(length != "", F.struct(length.cast("bigint").alias("length"), F.nullif(offset, F.lit("")).cast("bigint").alias("offset")))


def decrypt(data: Column, key: Column, iv: Column) -> Column:
    """AES-CBC with PKCS#7. Null for data that isn't whole blocks, wrong padding or a wrong length of key or IV."""
    fits = (F.octet_length(data) % 16 == 0) & (F.octet_length(data) > 0) & (F.octet_length(iv) == 16) & F.octet_length(key).isin(16, 24, 32)
    return F.when(fits, F.try_aes_decrypt(F.concat(iv, data), key, F.lit("CBC"), F.lit("PKCS")))
