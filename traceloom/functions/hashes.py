"""Spark's xxhash64 of whole numbers over numpy arrays, for tasks that order many samples anew many times."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64(*values: int | np.ndarray) -> np.ndarray:
    """As F.xxhash64 of these columns: numbers and arrays of 32 bits are taken as int, arrays of 64 bits as bigint.

    With the other values fixed, different numbers of one type have different hashes.
    """
    h = np.array([42], np.uint64)
    for value in values:
        x = np.asarray(value, np.int32).reshape(-1) if isinstance(value, int) else np.asarray(value)
        if x.dtype.itemsize == 8:
            h = _turned((h + _P5 + np.uint64(8)) ^ (_turned(x.astype(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
        else:
            h = _turned((h + _P5 + np.uint64(4)) ^ (x.astype(np.uint32).astype(np.uint64) * _P1), 23) * _P2 + _P3
        for by, p in ((33, _P2), (29, _P3)):
            h = (h ^ (h >> np.uint64(by))) * p
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def numbered(df: DataFrame, name: str = "sample_id") -> Column:
    """The column as xxhash64 above takes it; of any type but int and bigint, its hash."""
    return F.col(name) if dict(df.dtypes)[name] in ("int", "bigint") else F.xxhash64(name)
