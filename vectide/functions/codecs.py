"""Number formats: 8-bit quantization, packed nibbles, 16-bit floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quantize_symmetric(v: Column, scale: float) -> Column:
    """Signed bytes, rounded half to even and clamped, as an array of ints."""
    inverse = 1.0 / max(scale, 1e-30)
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.rint(x.cast("double") * inverse).cast("int"))))


def dequantize_symmetric(q: Column, scale: float) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def quantize_affine(v: Column, scale: float, zero: int) -> Column:
    inverse = 1.0 / max(scale, 1e-30)
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.rint(x.cast("double") * inverse).cast("int") + zero)))


def dequantize_affine(q: Column, scale: float, zero: int) -> Column:
    return F.transform(q, lambda x: (x - zero).cast("double") * scale)


def pack_nibbles(codes: Column) -> Column:
    """Pairs of 4-bit codes as bytes (ints 0..255): the first of a pair is the low half; an odd last one stands alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / 2).cast("int"))
    at = lambda i: F.coalesce(F.get(codes, i), F.lit(0)).bitwiseAND(15)
    packed = F.transform(pairs, lambda p: at(p * 2).bitwiseOR(F.shiftleft(at(p * 2 + 1), 4)))
    return F.when(F.size(codes) > 0, packed).otherwise(F.array().cast("array<int>"))


def unpack_nibbles(packed: Column) -> Column:
    return F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(15), F.shiftright(b, 4).bitwiseAND(15))))


def _each_number(of):
    """An Arrow function that takes the numbers of all lists at once; nulls stay null."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(v):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = v.flatten()
        numbers = of(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float32))
        values = pa.array(numbers, pa.float32(), mask=flat.is_null().to_numpy(zero_copy_only=False))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values, mask=v.is_null())

    return run


#: The largest 16-bit float.
HALF_MOST = 65504.0


def _to_float16(x):
    import numpy as np

    return np.clip(x, -HALF_MOST, HALF_MOST).astype(np.float16).astype(np.float32)


def _to_bfloat16(x):
    import numpy as np

    bits = x.view(np.uint32).astype(np.uint64)
    rounded = ((bits + 0x7FFF + (bits >> np.uint64(16) & np.uint64(1))) & np.uint64(0xFFFF0000)).astype(np.uint32).view(np.float32)
    return np.where(np.isnan(x), x, rounded)


def through_float16(v) -> Column:
    """Each number as the nearest 16-bit float, ties to even, clamped to their range."""
    return _each_number(_to_float16)(v)


def through_bfloat16(v) -> Column:
    """Each number as the nearest float with an 8-bit mantissa, ties to even."""
    return _each_number(_to_bfloat16)(v)


def half_bits(x: Column) -> Column:
    """The bits of the 16-bit float nearest to a double, as a smallint: ties to even, clamped to their range."""
    size = F.least(F.abs(x.cast("double")), F.lit(HALF_MOST))
    guess = F.floor(F.log2(F.greatest(size, F.lit(2.0**-14))))  # a logarithm may miss a power of two by one
    power = lambda e: F.pow(F.lit(2.0), e)
    e = guess + F.when(size >= power(guess + 1), 1).when((size < power(guess)) & (guess > -14), -1).otherwise(0)
    bits = (F.rint(size * power(10 - e)) + (e + 14) * 1024).cast("int")
    negative = F.when(x < 0, F.lit(-0x8000)).otherwise(F.lit(0))
    return F.when(F.isnan(x), F.lit(0x7E00)).when(x.isNotNull(), bits + negative).cast("smallint")


def from_half_bits(bits: Column) -> Column:
    """The double that ``half_bits`` stand for."""
    b = bits.cast("int")
    e, m = F.shiftright(b, 10).bitwiseAND(31), b.bitwiseAND(1023)
    size = F.when(e == 0, m * F.lit(2.0**-24)).otherwise((m + 1024) * F.pow(F.lit(2.0), e - 25))
    special = F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(e == 31, special).otherwise(size) * F.when(b < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
