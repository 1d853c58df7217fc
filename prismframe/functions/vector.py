"""Column builders over ARRAY columns: distances, projections, quantisation, packing, lookups. All of them stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column


def d(c: Column) -> Column:
    return c.cast("double")


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


# ---------------------------------------------------------------- distances (DST)


def pairwise(a: Vector, b: Vector, f: Callable[[Column, Column], Column]) -> Column:
    """UDF01: the sum over positions of an elementwise function of two columns."""
    return total(F.zip_with(a, b, lambda x, y: f(d(x), d(y))))


def dot(a: Vector, b: Vector) -> Column:
    return pairwise(a, b, lambda x, y: x * y)


def l2(a: Vector, b: Vector) -> Column:
    """Squared Euclidean distance."""
    return pairwise(a, b, lambda x, y: (x - y) * (x - y))


def l1(a: Vector, b: Vector) -> Column:
    return pairwise(a, b, lambda x, y: F.abs(x - y))


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Vector, b: Vector) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hamming(a: Vector, b: Vector) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def hamming_bits(a: Vector, b: Vector) -> Column:
    """Differing bits of two ARRAY<BIGINT>."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def dot_fixed(a: Vector, v: Sequence[float]) -> Column:
    """The product with a short fixed vector, unrolled so that it is compiled; zero coefficients cost nothing."""
    terms = [d(a[i]) * F.lit(float(x)) for i, x in enumerate(v) if x]
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def argmin(arr: Column) -> Column:
    """Place of the first minimum."""
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int")


# ---------------------------------------------------------------- projections (PRE)


def center(v: Vector, mean: Vector) -> Vector:
    return F.zip_with(v, mean, lambda x, m: d(x) - m)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda an outer expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(v: Vector) -> Vector:
    """Unit length; a zero vector has null components."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(d(x), n)))


def z_normalize(v: Vector, eps: float = 1e-20) -> Vector:
    def scaled(c: Vector) -> Vector:
        return let(F.sqrt(dot(c, c) / F.size(c)), lambda sd: F.transform(c, lambda x: x / (sd + eps)))

    return let(let(total(F.transform(v, d)) / F.size(v), lambda m: F.transform(v, lambda x: d(x) - m)), scaled)


def spread_zeros(n_cols: int, n_zeros: int) -> list[int]:
    """Source place of every padded column, -1 for a zero; zeros are spread evenly behind equal stripes, the rest at the end."""
    if n_zeros <= 0:
        return list(range(n_cols))
    if n_cols < n_zeros:
        return [*range(n_cols), *[-1] * n_zeros]
    stripe = n_cols // n_zeros
    out: list[int] = []
    for z in range(n_zeros):
        out += [*range(z * stripe, (z + 1) * stripe), -1]
    return out + list(range(n_zeros * stripe, n_cols))


def padded(n_cols: int, multiple: int) -> list[int]:
    return spread_zeros(n_cols, -n_cols % multiple)


def gather(v: Vector, places: Sequence[int]) -> Vector:
    """Columns by place, -1 for zero: permutations, padding, pruning."""
    return F.array(*(F.lit(0.0) if p < 0 else d(v[p]) for p in places))


def inverse_permutation(perm: Sequence[int]) -> list[int]:
    out = [0] * len(perm)
    for i, p in enumerate(perm):
        out[p] = i
    return out


def rotate(v: Vector, matrix: Sequence[Sequence[float]]) -> Vector:
    """Each output is the product of the vector with one row of the matrix."""
    return F.transform(F.array(*map(literal, matrix)), lambda r: dot(r, v))


def rotate_blocks(v: Vector, blocks: Sequence[Sequence[Sequence[float]]]) -> Vector:
    out, at = [], 0
    for b in blocks:
        out.append(rotate(F.slice(v, at + 1, len(b)), b))
        at += len(b)
    return F.flatten(F.array(*out))


def subspaces(v: Vector, spans: Sequence[tuple[int, int]]) -> Column:
    """ARRAY of slices (start, end)."""
    return F.array(*(F.slice(v, a + 1, b - a) for a, b in spans))


def even_spans(n_cols: int, n: int, wide_first: bool = True) -> list[tuple[int, int]]:
    """Spans of n subspaces of n_cols columns; those one wider stand first (or last)."""
    short, wide = divmod(n_cols, n)
    sizes = [short + 1] * wide + [short] * (n - wide)
    sizes = sizes if wide_first else sizes[::-1]
    out, at = [], 0
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


# ---------------------------------------------------------------- quantisation (PRE09-PRE14)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def affine_u8(x: Column, offset: Column | float, scale: Column | float, rounding: str = "floor", top: int = 255) -> Column:
    """An unsigned integer of (x - offset) * scale, saturated; ``rounding``: floor, trunc, rint or half (add a half, cut)."""
    offset, scale = (F.lit(float(c)) if isinstance(c, (int, float)) else c for c in (offset, scale))
    y = (x - offset) * scale
    y = {"floor": F.floor, "trunc": lambda z: F.when(z < 0, F.ceil(z)).otherwise(F.floor(z)), "rint": F.rint, "half": lambda z: F.floor(z + 0.5)}[rounding](y)
    return F.least(F.lit(top), F.greatest(F.lit(0), y.cast("int")))


def saturate_i8(x: Column) -> Column:
    return F.greatest(F.lit(-128), F.least(F.lit(127), F.rint(x).cast("int")))


def zigzag(x: Column) -> Column:
    return F.shiftleft(F.abs(x), 1) - (x > 0).cast("int")


def unzigzag(z: Column) -> Column:
    """0, 1, -1, 2, -2, ... of 0, 1, 2, 3, 4, ..."""
    return F.when(z.bitwiseAND(F.lit(1)) == 1, F.shiftright(z + 1, 1)).otherwise(-F.shiftright(z, 1))


def _bit_length(x: Column) -> Column:
    """Bits of a non-negative integer, 0 of 0; exact, without logarithms."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x.cast("long")))).cast("int")


def nbits_signed(x: Column) -> Column:
    """Bits of x in two's complement: 0 of 0, else those of |x| less one for negatives, and a sign."""
    x = x.cast("long")
    return F.when(x == 0, F.lit(0)).when(x > 0, _bit_length(x) + 1).otherwise(_bit_length(-x - 1) + 1)


def nbits_unsigned(x: Column) -> Column:
    return _bit_length(x)


# ---------------------------------------------------------------- codes and lookups (VQ, PRE15)


def pack_nibbles(codes: Column, n: int) -> Column:
    """Two 4-bit codes a byte, the first one low."""
    return F.array(*((codes[2 * i] + F.shiftleft(codes[2 * i + 1], 4)).cast("int") for i in range(n // 2)))


def unpack_nibbles(packed: Column, n: int) -> Column:
    return F.array(*(f(packed[i]) for i in range(n // 2) for f in (lambda c: c.bitwiseAND(F.lit(15)), lambda c: F.shiftright(c, 4).bitwiseAND(F.lit(15)))))


def pack_bits(values: Vector, nbits: int) -> Column:
    """PRE13: the low ``nbits`` bits of every value, the lowest first, one after the other in bytes that are filled from their high bit."""
    bits = F.array_join(F.transform(values, lambda x: F.reverse(F.lpad(F.bin(x.cast("long").bitwiseAND(F.lit((1 << nbits) - 1))), nbits, "0"))), "")
    n = F.ceil(F.size(values) * nbits / 8).cast("int")
    byte = lambda i: F.conv(F.rpad(F.substring(bits, i * 8 + 1, F.lit(8)), 8, "0"), 2, 10).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), byte))


def non_zero(v: Vector) -> Column:
    """FLT04: whether any component is not zero."""
    return F.exists(v, lambda x: x != 0)


def pack_long(codes: Column, n: int, bits: int = 4) -> Column:
    """Up to 64 / bits codes in one BIGINT."""
    out = F.lit(0).cast("long")
    for i in range(n):
        out = out.bitwiseOR(F.shiftleft(codes[i].cast("long"), i * bits))
    return out


def lookups(codes: Column, lut: Column, n: int, k: int) -> list[Column]:
    """The entry of each codebook: element code of the codebook's part of a flat table. Unrolled: compiled, five times a fold's speed."""
    return [lut[F.lit(c * k) + codes[c].cast("int")] for c in range(n)]


def lut_sum(codes: Column, lut: Column, n: int, k: int = 16) -> Column:
    terms = lookups(codes, lut, n, k)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def lut_sum_u8(codes: Column, lut: Column, n: int, k: int = 16) -> Column:
    """Saturating 8-bit accumulation: of non-negative terms, the clipped sum."""
    return F.least(F.lit(255), lut_sum(codes, lut, n, k))


def lut_sum_pairs(codes: Column, lut: Column, n: int, k: int = 16) -> Column:
    """Pairs saturate at 8 bits, their sum doesn't."""
    terms = lookups(codes, lut, n, k)
    out = F.lit(0)
    for i in range(0, n, 2):
        out = out + F.least(F.lit(255), terms[i] + terms[i + 1] if i + 1 < n else terms[i])
    return out


def lut_sum_signed(codes: Column, lut: Column, n: int, k: int = 16) -> Column:
    """Signed saturating 8-bit accumulation, in code order (the order matters)."""
    out = F.lit(0)
    for t in lookups(codes, lut, n, k):
        out = F.greatest(F.lit(-128), F.least(F.lit(127), out + t))
    return out


def lut_sum_grouped(codes: Column, lut: Column, n: int, k: int = 16, every: int = 16, top: int = 255) -> Column:
    """Sums of groups of ``every`` codebooks, each clipped at ``top``."""
    terms = lookups(codes, lut, n, k)
    out = F.lit(0)
    for i in range(0, n, every):
        part = terms[i]
        for t in terms[i + 1 : i + every]:
            part = part + t
        out = out + F.least(F.lit(top), part)
    return out


def lut_mean(codes: Column, lut: Column, n: int, k: int = 16, every: int = 16) -> Column:
    """Averaging accumulation: pairs are averaged, rounding up, to one value a group of up to ``every`` (a power of two) codebooks;
    the sum of groups is scaled back and the upward bias C / 4 * log2(every) taken off."""
    every = min(n, every)
    terms = lookups(codes, lut, n, k)
    out = F.lit(0)
    for i in range(0, n, every):
        level = terms[i : i + every]
        while len(level) > 1:
            level = [F.shiftright(a + b + 1, 1) for a, b in zip(level[::2], level[1::2], strict=True)]
        out = out + level[0]
    return out * every - int(n / 4 * math.log2(every))


# ---------------------------------------------------------------- trees (MIT07, MIT08)


def tree_code(v: Vector, levels: Sequence[dict]) -> Column:
    """The leaf of a hash tree: at each level all nodes split on one dimension, node g at its own value; left is 2g, right 2g + 1.

    A level has dim, vals (one a node), and optionally offset and scale, which the value goes through first.
    """
    values = [(d(v[s["dim"]]) - F.lit(float(s.get("offset", 0.0)))) * F.lit(float(s.get("scale", 1.0))) for s in levels]

    def node(level: int, g: int) -> Column:
        # a decision a node: nothing is computed twice on the way to a leaf, and the code stays short enough to be compiled
        if level == len(levels):
            return F.lit(g)
        return F.when(values[level] > F.lit(float(levels[level]["vals"][g])), node(level + 1, 2 * g + 1)).otherwise(node(level + 1, 2 * g))

    return node(0, 0)


def split_code(v: Vector, splits: Sequence[tuple[int, float]]) -> Column:
    """Bit i of the code: whether the vector's dimension of split i is over its value."""
    out = F.lit(0)
    for i, (dim, val) in enumerate(splits):
        out = out + F.shiftleft((d(v[dim]) > F.lit(float(val))).cast("int"), i)
    return out


def hadamard(n_rows: int, n_cols: int) -> list[list[int]]:
    """The first columns of the Hadamard matrix: -1 to the number of common bits."""
    return [[1 - 2 * ((i & j).bit_count() & 1) for j in range(n_cols)] for i in range(n_rows)]
