"""Digests, perceptual bits, Hamming distance and the deterministic hash embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS = 64
#: Labels and captions of the stand-in extractor.
LABELS = ("person", "car", "tree", "building", "dog", "chair", "sign")
CAPTIONS = ("outdoor urban scene", "indoor room", "natural landscape", "street view")


def file_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def dhash_bits(gray: Column) -> Column:
    """64 signs of a 9 wide, 8 high gray array, row by row: 1 where a pixel is brighter than its right neighbour."""
    at = lambda i: F.get(gray, (i / 8).cast("int") * 9 + i % 8)
    right = lambda i: F.get(gray, (i / 8).cast("int") * 9 + i % 8 + 1)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(at(i) > right(i), "1").otherwise("0")), "")


def bits_to_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.conv(bits, 2, 16)), 16, "0")


def hex_to_long(h: Column) -> Column:
    return F.conv(F.nullif(h, F.lit("")), 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; 64 if either is empty."""
    return F.coalesce(F.bit_count(hex_to_long(a).bitwiseXOR(hex_to_long(b))), F.lit(64)).cast("int")


def seed_of(path: Column) -> Column:
    return F.conv(F.substring(F.sha2(path, 256), 1, 8), 16, 10).cast("bigint")


def stub_labels(path: Column) -> Column:
    pool, seed = F.array(*map(F.lit, LABELS)), seed_of(path)
    return F.array_distinct(F.array(F.get(pool, (seed % 7).cast("int")), F.get(pool, (F.floor(seed / 7) % 7).cast("int"))))


def stub_caption(path: Column) -> Column:
    return F.get(F.array(*map(F.lit, CAPTIONS)), (seed_of(path) % 4).cast("int"))


#: Words whose buckets a worker remembers, and the longest of them: some megabytes, whatever the texts hold.
WORDS, LONGEST = 65_536, 32
_BUCKETS: dict[str, int] = {}


def bucket(token: str) -> int:
    found = _BUCKETS.get(token)
    if found is None:
        found = hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()[-1] % DIMENSIONS
        if len(token) <= LONGEST:
            if len(_BUCKETS) >= WORDS:
                _BUCKETS.clear()
            _BUCKETS[token] = found
    return found


@F.arrow_udf(ArrayType(DoubleType()))
def _embedded(texts: pa.Array) -> pa.Array:
    """Unit vectors of words joined by spaces; only one text is a string, and in pieces, at a time."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, text in enumerate(texts):
        if text := text.as_py():
            out[i] = np.bincount([bucket(w) for w in text.split(" ")], minlength=DIMENSIONS)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1)), 1.0)[:, None]  # a text with words has a length of 1 or more
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, DIMENSIONS, dtype=np.int32)), pa.array(out.ravel()))


def hash_embedding(text: Column) -> Column:
    """Token counts by last digest byte modulo 64, of unit length; zeros for blank text. Words hold no white space, so they go to Python as one string."""
    from .text import tokens

    return _embedded(F.array_join(tokens(text), " "))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def is_nonzero(v: Column) -> Column:
    """False for null, empty and all-zero vectors."""
    return F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(v.cast("array<double>"))
