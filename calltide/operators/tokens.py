"""Tokens in the place of values: numeric, alphanumeric, hashed, encrypted, and ones that keep the value's format and can be undone.

Format-preserving tokens are a keyed Feistel network over the digits of a value and another over its letters: each is a
permutation of all strings of that length, so no two values of one form meet, and whoever has the key can go back. Marks and
blanks, and whether a letter is a capital, stay where they are.
"""

from __future__ import annotations

import hmac
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters of tokens.
DIGITS = "0123456789"
ALPHANUMERIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ROUNDS = 10
#: Values whose tokens a task remembers; a batch may add its own.
MEMO = 100_000


def from_hash(value: Column, alphabet: str, length: int) -> Column:
    """For each of the first bytes of the value's SHA-256 the character at that byte modulo the alphabet's size; at most 32."""
    if not 0 < length <= 32:
        raise ValueError("a hash has 32 bytes")
    h = F.sha2(value, 256)
    at = lambda i: (F.conv(F.substring(h, F.lit(2) * i + F.lit(1), F.lit(2)), 16, 10).cast("int") % len(alphabet)) + 1
    out = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.substring(F.lit(alphabet), at(i), F.lit(1))), "")
    return F.when(value.isNotNull(), out)


def numeric(value: Column, length: int = 10) -> Column:
    return from_hash(value, DIGITS, length)


def alphanumeric(value: Column, length: int = 8, case_sensitive: bool = True) -> Column:
    out = from_hash(value, ALPHANUMERIC, length)
    return out if case_sensitive else F.lower(out)


def hashed(value: Column, length: int = 16) -> Column:
    return F.left(F.sha2(value, 256), F.lit(length))


def encrypted(value: Column, key: Column | str, key_id: str = "default") -> Column:
    """AES-256-GCM under a key of 32 bytes, as key id, initialisation vector, text and tag in hexadecimal; differs at each call."""
    out = F.lower(F.hex(F.aes_encrypt(value.cast("binary"), F.lit(key) if isinstance(key, str) else key, F.lit("GCM"))))
    return F.concat(F.lit(f"{key_id}:"), F.regexp_replace(out, "^(.{24})(.*)(.{32})$", "$1:$2:$3"))  # one call: each has a vector of its own


def decrypted(token: Column, key: Column | str) -> Column:
    """The value of a token of :func:`encrypted`; null if the key or the token isn't right."""
    parts = F.split(token, ":")
    body = F.unhex(F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))))
    return F.try_aes_decrypt(body, F.lit(key) if isinstance(key, str) else key, F.lit("GCM")).cast("string")


def dressed(token: Column, prefix: str = "", suffix: str = "", checksum: bool = False) -> Column:
    """With a prefix, a suffix, and the first four characters of the MD5 of all that."""
    out = F.concat(F.lit(prefix), token, F.lit(suffix))
    return F.concat(out, F.left(F.md5(out), F.lit(4))) if checksum else out


def checksum_holds(token: Column) -> Column:
    body = F.substring(token, F.lit(1), F.char_length(token) - 4)
    return F.left(F.md5(body), F.lit(4)) == F.right(token, F.lit(4))


def _round(key: bytes, tweak: str, i: int, half: int, size: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{tweak}:{i}:{half}".encode(), "sha256")) % size


def permuted(number: int, length: int, base: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A permutation of the numbers of ``length`` digits in ``base``: halves that each take a keyed function of the other, in turns.

    With an odd length one half is longer; a single digit is moved by a keyed distance.
    """
    tweak = f"{tweak}:{length}:{base}"
    if length == 1:
        away = _round(key, tweak, 0, 0, base)
        return (number + (-away if back else away)) % base
    right = base ** (length // 2)
    left = base ** (length - length // 2)
    a, b = divmod(number, right)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2 == 0:
            a = (a + sign * _round(key, tweak, i, b, left)) % left
        else:
            b = (b + sign * _round(key, tweak, i, a, right)) % right
    return a * right + b


def _replaced(value: str, alphabet: str, key: bytes, tweak: str, back: bool) -> str:
    at = [i for i, c in enumerate(value) if c in alphabet]
    if not at:
        return value
    base, n = len(alphabet), 0
    for i in at:
        n = n * base + alphabet.index(value[i])
    n, out = permuted(n, len(at), base, key, tweak, back), list(value)
    for i in reversed(at):
        n, d = divmod(n, base)
        out[i] = alphabet[d]
    return "".join(out)


def preserving_token(value: str, key: bytes, back: bool = False, tweak: str = "") -> str:
    """The value with its digits (0-9) and letters (A-Z, a-z) put in others' places; ``back`` undoes that. Other characters stay."""
    capital = [c.isascii() and c.isupper() for c in value]
    low = "".join(c.lower() if up else c for c, up in zip(value, capital, strict=True))
    out = _replaced(_replaced(low, DIGITS, key, tweak, back), "abcdefghijklmnopqrstuvwxyz", key, tweak, back)
    return "".join(c.upper() if up else c for c, up in zip(out, capital, strict=True))


def _preserve(batches: Iterator[pa.RecordBatch], columns: dict[str, str], key: bytes, back: bool, tweak: str) -> Iterator[pa.RecordBatch]:
    memo: dict[str, str] = {}  # of a task, begun anew when it is full
    for batch in batches:
        made = []
        for name in columns:
            memo = memo if len(memo) < MEMO else {}
            made.append(pa.array([None if v is None else memo.get(v) or memo.setdefault(v, preserving_token(v, key, back, tweak)) for v in batch.column(name).to_pylist()], pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *columns.values()])


def format_preserving(df: DataFrame, columns: dict[str, str], key: bytes, back: bool = False, tweak: str = "") -> DataFrame:
    """All columns, and for each of ``columns`` (from a text column to a new one) its tokens, or with ``back`` the values of its tokens.

    Nulls and empty texts stay so. The key is any bytes; a ``tweak`` gives other tokens of the same key. No shuffle, no table of
    values and tokens: the key alone leads both ways.
    """
    from pyspark.sql.types import StringType, StructType

    if clash := set(columns.values()) & set(df.columns):
        raise ValueError(f"columns are there already: {', '.join(sorted(clash))}")
    schema = StructType([*df.schema.fields])
    for name in columns.values():
        schema = schema.add(name, StringType())
    return df.mapInArrow(partial(_preserve, columns=columns, key=key, back=back, tweak=tweak), schema)
