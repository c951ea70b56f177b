"""Exact spectra of integer matrices: characteristic polynomial, its real roots, null vectors.

Plain helpers on Python integers and NumPy residues; ``whitening`` runs them in Spark tasks,
one prime or one component each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt

import numpy as np

#: Bits of a root beyond the matrix's trace, and guard bits of the elimination.
ROOT_BITS, GUARD_BITS = 160, 96


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 2**32."""
    if n < 4 or n % 2 == 0:
        return n in (2, 3)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if base % n == 0 or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes() -> Iterator[int]:
    """Primes below 2**31, largest first."""
    return (n for n in range((1 << 31) - 1, 1 << 30, -2) if is_prime(n))


def coefficient_bound(trace: int, d: int) -> int:
    """Bound of the coefficients for a positive semidefinite matrix (Maclaurin's inequality)."""
    mean = -(-trace // d)
    return max(comb(d, k) * mean**k for k in range(d + 1))


def characteristic_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients (constant first) of det(xI - matrix) modulo ``p``, by Hessenberg reduction."""
    a = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        a[[k + 1, pivot]] = a[[pivot, k + 1]]
        a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        f = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - f[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * f % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(d):
        weight, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            product = product * int(a[i + 1, i]) % p
            weight[i] = product * int(a[i, k]) % p
        row = -(int(a[k, k]) * poly[k] % p)
        row[1:] += poly[k, :-1]
        poly[k + 1] = (row - (weight[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d].tolist()


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Integers of least size with the given residues (prime, values), by Chinese remaindering."""
    whole = 1
    for p, _ in residues:
        whole *= p
    parts = [(whole // p) * pow(whole // p, -1, p) for p, _ in residues]
    out = []
    for values in zip(*(v for _, v in residues), strict=True):
        x = sum(r * part for r, part in zip(values, parts, strict=True)) % whole
        out.append(x - whole if 2 * x > whole else x)
    return out


def _roots_above(poly: list[int], a: int) -> int:
    """Roots above ``a`` with multiplicity: for real roots only, the sign changes of poly(x + a)."""
    c = list(poly)
    n = len(c) - 1
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], a: int) -> int:
    x = 0
    for c in reversed(poly):
        x = x * a + c
    return (x > 0) - (x < 0)


def root(poly: list[int], k: int, trace: int) -> tuple[int, int, int, int, int]:
    """The k-th largest root of a polynomial with roots >= 0, known to be positive.

    Returns (lo, hi, scale, place, group): it lies in (lo, hi] / 2**scale with ``group``
    roots (equal to the precision used), of which it is number ``place``.  Intervals are
    halved by exact counts until the root is alone, then by exact signs.
    """
    scale, lo, hi = 0, 0, 1 << (trace.bit_length() + 1)
    above_lo, above_hi = len(poly) - 1, 0
    while True:
        wide = hi - lo
        if lo and (wide << ROOT_BITS) <= trace << scale and (wide << 64) <= lo:
            return lo, hi, scale, k - above_hi, above_lo - above_hi
        if wide == 1:
            # halve the unit: the roots of the new polynomial are twice as large
            scale, lo, hi = scale + 1, 2 * lo, 2 * hi
            n = len(poly) - 1
            poly = [c << (n - i) for i, c in enumerate(poly)]
        mid = (lo + hi) // 2
        if above_lo - above_hi > 1:
            above = _roots_above(poly, mid)
        else:
            sign = _sign(poly, mid)
            # the parity of the roots above decides the sign, unless mid is the root
            above = above_hi if sign == 0 or (sign > 0) == (above_hi % 2 == 0) else above_lo
        if above >= k:
            lo, above_lo = mid, above
        else:
            hi, above_hi = mid, above


def null_vectors(matrix: list[list[int]], lo: int, hi: int, scale: int, group: int) -> list[list[float]]:
    """Orthonormal vectors of the ``group``-fold eigenvalue in (lo, hi] / 2**scale.

    Elimination in fixed point with full pivoting leaves ``group`` pivots near zero; the
    null vectors from back substitution are improved by one step of inverse iteration.
    """
    d = len(matrix)
    bits = scale + GUARD_BITS
    shift = (lo + hi) << (bits - scale - 1)
    a = np.array(matrix, dtype=object) << bits
    for i in range(d):
        a[i, i] -= shift
    rows, columns, rank = list(range(d)), list(range(d)), d - group
    for k in range(rank):
        at = int(np.argmax(np.abs(a[k:, k:])))
        r, c = k + at // (d - k), k + at % (d - k)
        a[[k, r]] = a[[r, k]]
        a[:, [k, c]] = a[:, [c, k]]
        rows[k], rows[r], columns[k], columns[c] = rows[r], rows[k], columns[c], columns[k]
        f = np.array([(v << bits) // a[k, k] for v in a[k + 1:, k]], dtype=object)
        a[k + 1:, k + 1:] -= np.outer(f, a[k, k + 1:]) >> bits
        a[k + 1:, k] = f

    def back(right: list[int]) -> list[int]:
        """x with U x = right over the first ``rank`` rows; the other entries are given."""
        x = list(right)
        for i in range(rank - 1, -1, -1):
            rest = (x[i] << bits) - sum(int(a[i, j]) * x[j] for j in range(i + 1, d))
            x[i] = rest // int(a[i, i])
        return x

    def unit(x: list[int]) -> list[int]:
        norm = isqrt(sum(v * v for v in x))
        return [(v << bits) // norm for v in x]

    found: list[list[int]] = []
    for free in range(group):
        x = unit(back([0] * rank + [(1 << bits) if j == free else 0 for j in range(group)]))
        plain = [0] * d
        for j, c in enumerate(columns):
            plain[c] = x[j]
        # inverse iteration: forward through L, then back with pivots of one unit for zero
        y = [plain[r] for r in rows]
        for i in range(d):
            y[i] -= sum(int(a[i, j]) * y[j] for j in range(min(i, rank))) >> bits
        y = back(y[:rank] + [v << bits for v in y[rank:]])
        better = [0] * d
        for j, c in enumerate(columns):
            better[c] = y[j]
        for vector in (better, plain):
            if not any(vector):
                continue
            v = unit(vector)
            for other in found:
                dot = sum(p * q for p, q in zip(v, other, strict=True)) >> bits
                v = [p - (dot * q >> bits) for p, q in zip(v, other, strict=True)]
            if max(map(abs, v)) >> (bits - 32):
                found.append(unit(v))
                break
    out = []
    for v in found:
        lead = max(v, key=abs)
        # the entry of largest size is positive, so that every task takes the same sign
        out.append([(x if lead > 0 else -x) / (1 << bits) for x in v])
    return out
