"""Feature-hashed sparse vectors.

A token's BLAKE2b digest of 8 bytes gives its index (first four bytes, big-endian, modulo the
dimensions) and its sign (fifth byte even: plus). Spark has no such hash, so tokens are hashed in
Arrow batches, each distinct token of a batch once, without a Python object for any other.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def slot(token: str, dimensions: int) -> tuple[int, float]:
    d = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(d[:4], "big") % dimensions, -1.0 if d[4] % 2 else 1.0


def vector_of(tokens, dimensions: int) -> dict[int, float]:
    out: dict[int, float] = {}
    for t in tokens:
        i, sign = slot(t, dimensions)
        out[i] = out.get(i, 0.0) + sign
    norm = math.sqrt(math.fsum(v * v for v in out.values()))
    return {i: v / norm for i, v in out.items()} if norm else out


def vectors_of(batch: pa.Array, dimensions: int) -> pa.Array:
    """list<string> -> list<struct<i, v>> in order of i, as ``vector_of`` has it; null stays null."""
    batch = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    n = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = batch.flatten().dictionary_encode()
    slots = [slot(t, dimensions) for t in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    index, sign = (np.array([s[k] for s in slots], kind)[code] if slots else np.zeros(0, kind) for k, kind in ((0, np.int64), (1, np.float64)))
    place, at = np.unique(np.repeat(np.arange(len(n)), n) * dimensions + index, return_inverse=True)
    row, value = place // dimensions, np.bincount(at, weights=sign, minlength=len(place)).astype(np.float64)
    length = np.sqrt(np.bincount(row, weights=value * value, minlength=len(n)))  # sums of whole numbers: exact
    value = np.divide(value, length[row], out=value, where=length[row] > 0)
    items = pa.StructArray.from_arrays([pa.array((place % dimensions).astype(np.int32)), pa.array(value)], names=["i", "v"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), items, mask=batch.is_null() if batch.null_count else None)


def hashed_vector(tokens: str | Column, dimensions: int) -> Column:
    """array<string> -> map<int, double>, L2-normalised unless all signs cancel."""

    @F.arrow_udf("array<struct<i:int,v:double>>")
    def run(batch: pa.Array) -> pa.Array:
        return vectors_of(batch, dimensions)

    return F.map_from_entries(run(tokens))


def vector_json(vector: str | Column) -> Column:
    """map<int, double> as JSON text with keys in numeric order."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(vector))))


def load_vector(text: str | Column) -> Column:
    """JSON text as map<int, double>; what is no object is empty, items that are no numbers are left out."""
    read = F.from_json(text, "map<string,string>")
    items = F.transform(F.map_entries(F.coalesce(read, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].try_cast("int").alias("i"), e["value"].try_cast("double").alias("v")))
    return F.map_from_entries(F.filter(items, lambda e: e["i"].isNotNull() & e["v"].isNotNull()))
