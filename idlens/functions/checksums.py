"""Check digits: Verhoeff for 12-digit ids, ICAO 9303 for machine-readable zones.

Both fold over their digits with built-in functions; no UDF is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idlens.functions.text import let

# Fixed value: the permutation that Verhoeff's scheme repeats per digit position.
_BASE_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _dihedral(j: int, k: int) -> int:
    """Product in the symmetry group of the pentagon: 0-4 rotations, 5-9 reflections."""
    if j < 5:
        return (j + k) % 5 if k < 5 else 5 + (j + k - 5) % 5
    return 5 + (j - 5 - k) % 5 if k < 5 else (j - k) % 5


def _permutations() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([_BASE_PERMUTATION[d] for d in rows[-1]])
    return rows


PRODUCT = [_dihedral(j, k) for j in range(10) for k in range(10)]
PERMUTATION = _permutations()


def _looked_up(values: list[int], index: Column) -> Column:
    """Entry of a table of single digits, kept as one text literal."""
    return F.ascii(F.substring(F.lit("".join(map(str, values))), index + 1, 1)) - 48


def verhoeff_valid(c: Column, length: int = 12) -> Column:
    """MTH-1: true iff the digits of `c` number `length` and check to zero."""
    moves = [d for row in PERMUTATION for d in row]

    def state(digits: Column) -> Column:
        def step(value: Column, i: Column) -> Column:
            digit = F.ascii(F.substring(digits, length - i, 1)) - 48
            return _looked_up(PRODUCT, value * 10 + _looked_up(moves, (i % 8) * 10 + digit))

        return F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0), step)

    checked = let(F.regexp_replace(c, "[^0-9]", ""), lambda d: F.when(F.length(d) == length, state(d) == 0))
    return F.coalesce(checked, F.lit(False))


# Fixed values of ICAO Doc 9303: character values and repeating weights.
ICAO_CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ICAO_WEIGHTS = (7, 3, 1)


def icao_digit(c: Column, length: int) -> Column:
    """Check digit of the first `length` characters ('<' counts 0)."""
    weights = F.array(*[F.lit(w) for w in ICAO_WEIGHTS])

    def weighted(ch: Column, i: Column) -> Column:
        value = F.greatest(F.position(ch, F.lit(ICAO_CHARACTERS)) - 1, F.lit(0))
        return value * F.get(weights, i % 3)

    values = F.transform(F.split(F.substring(c, 1, length), ""), weighted)
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v) % 10


def icao_matches(data: Column, length: int, digit: Column, empty_ok: bool = False) -> Column:
    """MTH-2: does `digit` check `data`? With `empty_ok` a filler stands for 0."""
    ok = icao_digit(data, length).cast("string") == digit
    return (ok | ((digit == "<") & (F.regexp_replace(data, "<", "") == ""))) if empty_ok else ok
