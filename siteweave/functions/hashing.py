"""A seeded integer hash that Spark, numpy and any SQL engine compute alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes are below this.
RANGE = 1 << 32
_MASK, _FACTOR = RANGE - 1, 0x45D9F3B


def _mixed(x: Column) -> Column:
    """A bijection of 32-bit numbers in which every bit of x reaches every bit."""
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * _FACTOR).bitwiseAND(_MASK)
    return x.bitwiseXOR(F.shiftright(x, 16))


def _mixed_number(x):
    """The same for a number or an array of 64-bit numbers."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * _FACTOR) & _MASK
    return x ^ (x >> 16)


def seeded(seed: int) -> int:
    return _mixed_number((seed * 9176 + 11) & _MASK)


def portable_hash(key: Column, seed: int) -> Column:
    """A hash of key and seed in [0, RANGE); null as 0. Two seeds order the same keys independently."""
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    k = k.bitwiseAND(_MASK).bitwiseXOR(F.shiftright(k, 32).bitwiseAND(_MASK))
    return _mixed(_mixed(k.bitwiseXOR(seeded(seed))).bitwiseXOR(seeded(~seed)))


def draw_hash(hashed: Column, number: Column) -> Column:
    """A further hash of a hash for each number (a replicate, say)."""
    return _mixed(hashed.bitwiseXOR(_mixed(number.cast("long"))))


def draw_hashes(hashed: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """draw_hash() of all hashes (rows) and numbers (columns)."""
    return _mixed_number(hashed[:, None] ^ _mixed_number(numbers.astype(np.int64))[None, :])


def portable_hash_sql(key: str, seed: int) -> str:
    """portable_hash() in SQL, of a key from 0 on."""
    k = f"xor(({key}) & {_MASK}, ({key}) >> 32)"
    return mixed_sql(f"xor({mixed_sql(f'xor({k}, {seeded(seed)})')}, {seeded(~seed)})")


def mixed_sql(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {_FACTOR}) & {_MASK})"
    return f"xor({x}, {x} >> 16)"


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the hash."""
    return portable_hash(key, seed) / float(RANGE)
