"""Masks and generalisations of numbers, content and values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN_NUMBER, HIDDEN_CONTENT = "***-***-****", "[Content Hidden]"


def mask_number(number: Column) -> Column:
    """First three and last four characters; null or under four characters: all hidden."""
    short = number.isNull() | (F.char_length(number) < 4)
    return F.when(short, HIDDEN_NUMBER).otherwise(F.concat(F.substring(number, 1, 3), F.lit("-***-"), F.right(number, F.lit(4))))


def mask_content(content: Column, hide: Column, shown: str = HIDDEN_CONTENT) -> Column:
    return F.when(content.isNotNull() & hide, shown).otherwise(content)


def partial_mask(value: Column, keep_first: int = 3, keep_last: int = 4, mark: str = "*") -> Column:
    """The middle replaced by ``mark``; values too short for that are masked whole."""
    n = F.char_length(value)
    middle = F.concat(F.substring(value, 1, keep_first), F.repeat(F.lit(mark), n - keep_first - keep_last), F.right(value, F.lit(keep_last)))
    return F.when(n > keep_first + keep_last, middle).otherwise(F.repeat(F.lit(mark), n))


def number_range(value: Column, level: int) -> Column:
    """The range of width 10**level that holds a number, as text: ``20-29`` for 25 at level 1."""
    width = 10**level
    low = (F.floor(value / width) * width).cast("bigint")
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def time_range(ts: Column, level: int) -> Column:
    """A moment cut to its hour, day, month or year (levels 1 to 4)."""
    return F.date_trunc({1: "hour", 2: "day", 3: "month", 4: "year"}[level], ts)


def hash_token(value: Column, salt: str = "", length: int = 16) -> Column:
    return F.left(F.sha2(F.concat(F.lit(salt), value), 256), F.lit(length))


def numeric_token(value: Column, salt: str = "", digits: int = 10) -> Column:
    """Decimal digits from a hash; not invertible, equal for equal values."""
    number = F.conv(F.left(F.sha2(F.concat(F.lit(salt), value), 256), F.lit(12)), 16, 10).cast("decimal(20,0)")
    return F.lpad((number % (10**digits)).cast("decimal(20,0)").cast("string"), digits, "0")


def k_level(k: int) -> int:
    """The level of generalisation that stands for k: ceil(log10 k)."""
    level = 0
    while 10**level < k:
        level += 1
    return level


def laplace_noise(sensitivity: float, epsilon: float, seed: int) -> Column:
    """Laplace noise of scale sensitivity / epsilon by the inverse of its distribution; repeatable for a seed and a layout."""
    u = F.rand(seed) - 0.5
    return -F.signum(u) * F.lit(sensitivity / epsilon) * F.log(1 - 2 * F.abs(u) + F.lit(1e-12))


def gaussian_noise(sigma: float, seed: int) -> Column:
    return F.randn(seed) * sigma
