"""Scalar functions: identifiers, decimals, documents, hashes, vectors, text scores and integer codecs."""

import hashlib
import hmac
import json
import math
import struct

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# identifiers ------------------------------------------------------------------------------------------------------
def guid_from_halves(high: Column, low: Column) -> Column:
    """The canonical text of a 128-bit identifier held as two 64-bit integers."""
    h = F.concat(F.lpad(F.lower(F.hex(high)), 16, "0"), F.lpad(F.lower(F.hex(low)), 16, "0"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _signed(hex_text: Column) -> Column:
    """16 hex digits as a signed 64-bit integer."""
    unsigned = F.conv(hex_text, 16, 10).cast("decimal(20,0)")
    half, whole = (F.lit(str(2**k)).cast("decimal(20,0)") for k in (63, 64))
    return F.when(unsigned >= half, unsigned - whole).otherwise(unsigned).cast("long")


def guid_halves(guid: Column) -> tuple[Column, Column]:
    h = F.regexp_replace(guid, "-", "")
    return _signed(F.substring(h, 1, 16)), _signed(F.substring(h, 17, 16))


def guid_from_bytes(raw: Column) -> Column:
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def guid_to_bytes(guid: Column) -> Column:
    return F.unhex(F.regexp_replace(guid, "-", ""))


# decimals ---------------------------------------------------------------------------------------------------------
def decimal128(value: Column, scale: int = 10) -> Column:
    """A decimal of 38 digits; values that do not fit become NULL."""
    return value.try_cast(f"decimal(38,{scale})")


def decimal_text(value: Column) -> Column:
    """Decimal text without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


# documents --------------------------------------------------------------------------------------------------------
def json_field(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, f"$.{path}")


def decode_cbor(data: bytes):
    """One CBOR item: integers, bytes, text, arrays, maps, tags (their content), floats and simple values."""
    value, _ = _cbor(data, 0)
    return value


def _cbor(data: bytes, at: int):
    major, info = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7:
        if info in (20, 21):
            return info == 21, at
        if info in (22, 23):
            return None, at
        size, code = {25: (2, ">e"), 26: (4, ">f"), 27: (8, ">d")}[info]
        return struct.unpack_from(code, data, at)[0], at + size
    if info < 24:
        n = info
    elif info < 28:
        size = 1 << (info - 24)
        n = int.from_bytes(data[at : at + size], "big")
        at += size
    else:
        return _cbor_open(data, at, major)
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        raw = data[at : at + n]
        return (raw.decode() if major == 3 else raw), at + n
    if major == 4:
        items = []
        for _ in range(n):
            item, at = _cbor(data, at)
            items.append(item)
        return items, at
    if major == 5:
        out = {}
        for _ in range(n):
            key, at = _cbor(data, at)
            out[key], at = _cbor(data, at)
        return out, at
    return _cbor(data, at)  # a tag


def _cbor_open(data: bytes, at: int, major: int):
    """An item of open length, ended by a break byte."""
    items = []
    while data[at] != 0xFF:
        item, at = _cbor(data, at)
        items.append(item)
    at += 1
    if major == 4:
        return items, at
    if major == 5:
        return dict(zip(items[::2], items[1::2])), at
    return (b"" if major == 2 else "").join(items), at


@F.pandas_udf(T.StringType())
def cbor_to_json(data: pd.Series) -> pd.Series:
    """CBOR documents as JSON text, for ``get_json_object`` or ``parse_json``; bytes become hex, broken documents NULL."""

    def one(raw):
        try:
            return None if raw is None else json.dumps(decode_cbor(bytes(raw)), default=lambda b: b.hex(), separators=(",", ":"))
        except (IndexError, KeyError, ValueError, TypeError, struct.error):
            return None

    return data.map(one).astype(object)


def cbor_field(data: Column, field: str) -> Column:
    return F.get_json_object(cbor_to_json(data), f"$.{field}")


# hashes and keys --------------------------------------------------------------------------------------------------
def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def row_fingerprint(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def crc32(value: Column) -> Column:
    return F.crc32(value.cast("binary"))


#: The 64-bit FNV-1a offset basis (as a signed long); its prime is 2**40 + 435.
FNV_BASIS, FNV_LOW = 0xCBF29CE484222325 - (1 << 64), 435


def fnv1a64(value: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, as a signed long. NULL for NULL.

    The product is built from 32-bit halves, as longs that overflow are errors.
    """
    raw, mask = value.cast("binary"), F.lit(0xFFFFFFFF)

    def step(h: Column, byte: Column) -> Column:
        low = h.bitwiseAND(mask).bitwiseXOR(byte)
        product = low * FNV_LOW
        high = F.shiftrightunsigned(h, 32) * FNV_LOW + F.shiftleft(low, 8) + F.shiftrightunsigned(product, 32)
        return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(product.bitwiseAND(mask))

    each = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    basis = F.lit(FNV_BASIS).cast("long")
    return F.when(F.octet_length(raw) == 0, basis).when(F.octet_length(raw) > 0, F.aggregate(each, basis, step))


def hkdf_sha256(key: bytes, info: bytes, salt: bytes = b"", length: int = 32) -> bytes:
    """RFC 5869: extract with ``salt``, then expand with ``info``."""
    strong = hmac.new(salt or bytes(32), key, hashlib.sha256).digest()
    out, block = b"", b""
    for k in range(1, math.ceil(length / 32) + 1):
        block = hmac.new(strong, block + info + bytes([k]), hashlib.sha256).digest()
        out += block
    return out[:length]


# vectors ----------------------------------------------------------------------------------------------------------
def as_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_from_blob(blob: pd.Series) -> pd.Series:
    """Little-endian float32 values."""
    return blob.map(lambda b: None if b is None else list(struct.unpack(f"<{len(b) // 4}f", bytes(b))))


@F.pandas_udf(T.BinaryType())
def vector_to_blob(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else struct.pack(f"<{len(v)}f", *v))


# text -------------------------------------------------------------------------------------------------------------
def text_score(text: Column, terms: list[str]) -> Column:
    """Occurrences of the terms (case-sensitive, not overlapping), a byte of the text."""
    total = F.lit(0.0)
    for term in terms:
        if term:
            total = total + (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(float(len(term)))
    return F.when(F.octet_length(text) > 0, total / F.octet_length(text)).otherwise(F.lit(0.0))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


# integer codecs ---------------------------------------------------------------------------------------------------
def delta(value: Column, window) -> Column:
    return value - F.lag(value).over(window)


def delta_of_delta(value: Column, window) -> Column:
    return value - 2 * F.lag(value, 1).over(window) + F.lag(value, 2).over(window)


def undelta(step: Column, window) -> Column:
    """Values from first differences, the first row holding the first value."""
    return F.sum(step).over(window.rowsBetween(Window.unboundedPreceding, 0))


def zigzag(value: Column) -> Column:
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-(value.bitwiseAND(F.lit(1))))


def timestamp_delta(ts: Column, base: str = "2024-01-01") -> Column:
    """Microseconds since ``base``."""
    return F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(base).cast("timestamp"))


# arithmetic of the dialect's CASE -----------------------------------------------------------------------------------
def int_div0(a: Column, b: Column) -> Column:
    """Truncating integer division that is 0 where the divisor is."""
    return F.when(b == 0, F.lit(0)).otherwise((a / F.when(b != 0, b)).cast("long"))


def mod0(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0)).otherwise(a % F.when(b != 0, b))
