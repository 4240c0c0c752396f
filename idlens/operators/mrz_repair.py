"""Repair of misread zone characters, led by the check digits (JN-15, MTH-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens.functions.checksums import ICAO_CHARACTERS, ICAO_WEIGHTS, icao_matches
from idlens.functions.text import let

# Letters and digits that readers take for one another.
LOOK_ALIKES = (("O", "0"), ("I", "1"), ("B", "8"), ("S", "5"))
LETTERS = "".join(a for a, _ in LOOK_ALIKES)
DIGITS = "".join(d for _, d in LOOK_ALIKES)
#: Start, length and kind of the four fields of the number line, each before its check digit.
FIELDS = ((0, 9, "mixed"), (13, 6, "digits"), (21, 6, "digits"), (28, 14, "mixed"))
COMPOSITE = ((0, 10), (13, 7), (21, 22))
NO_WAY = 99
STATE = "array<struct<cost:int,ways:int,text:string>>"


def as_digit(c: Column) -> Column:
    """A look-alike letter as its digit; other characters as they are."""
    return F.translate(c, LETTERS, DIGITS)


def swapped(c: Column) -> Column:
    """The look-alike of a character, itself where it has none."""
    return F.translate(c, LETTERS + DIGITS, DIGITS + LETTERS)


def _value(c: Column) -> Column:
    return F.greatest(F.position(c, F.lit(ICAO_CHARACTERS)) - 1, F.lit(0))


def repaired_field(data: Column, digit: Column, length: int, kind: str) -> Column:
    """struct(text, changes): the reading of a field with the fewest exchanged look-alikes
    that its check digit confirms, NULL where there is none or more than one.

    A dynamic program over the characters; its state is, for each weighted sum modulo 10,
    the fewest changes, the number of readings with that many, and one of them. So the
    2^n readings are never listed. In a "digits" field a look-alike letter must become its
    digit; a "mixed" field may hold either.
    """
    weights = F.array(*[F.lit(w) for w in ICAO_WEIGHTS])
    start = F.array(*[F.struct(F.lit(0 if r == 0 else NO_WAY).alias("cost"), F.lit(int(r == 0)).alias("ways"), F.lit("").alias("text")) for r in range(10)])

    def from_state(state: Column, rest: Column, to: Column, weight: Column, cost: Column) -> Column:
        """The state that reading `to` reaches for a sum of `rest`."""
        return let(F.get(state, F.pmod(rest - _value(to) * weight, F.lit(10))), lambda s: F.struct(
            (s["cost"] + cost).alias("cost"), s["ways"].alias("ways"), F.concat(s["text"], to).alias("text")))

    def better(a: Column, b: Column) -> Column:
        def choose(p: Column) -> Column:
            one, two = p["a"], p["b"]
            both = F.struct(one["cost"].alias("cost"), (one["ways"] + two["ways"]).alias("ways"), one["text"].alias("text"))
            return F.when(one["cost"] < two["cost"], one).when(two["cost"] < one["cost"], two).otherwise(both)

        return let(F.struct(a.alias("a"), b.alias("b")), choose)

    def step(state: Column, i: Column) -> Column:
        def moved(c: Column) -> Column:
            weight, other = F.get(weights, i % 3), as_digit(c) if kind == "digits" else swapped(c)

            def reach(rest: Column) -> Column:
                keep = from_state(state, rest, c, weight, F.lit(0))
                swap = from_state(state, rest, other, weight, F.lit(1))
                if kind == "digits":
                    return F.when(other == c, keep).otherwise(swap)
                return F.when(other == c, keep).otherwise(better(keep, swap))

            return F.transform(F.sequence(F.lit(0), F.lit(9)), reach)

        return let(F.substring(data, i + 1, 1), moved).cast(STATE)

    final = F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), start.cast(STATE), step)
    read = let(F.struct(as_digit(digit).alias("d"), final.alias("s")), lambda p: let(
        F.get(p["s"], F.when(p["d"].rlike("^[0-9]$"), p["d"].try_cast("int"))), lambda s: F.when(
            (s["cost"] < NO_WAY) & (s["ways"] == 1), F.struct(F.concat(s["text"], p["d"]).alias("text"), (s["cost"] + (p["d"] != digit).cast("int")).alias("changes")))))
    fits = F.when(~data.rlike("[^0-9<]") | F.lit(kind != "digits") | ~as_digit(data).rlike("[^0-9<]"), F.lit(True))
    return F.when(fits, read)


def _part(line: Column, start: int, length: int) -> Column:
    return F.substring(line, start + 1, length)


def zone_checks(line: Column) -> Column:
    """Whether all five digits of a number line are right."""
    ok = F.length(line) == 44
    for start, length, _ in FIELDS:
        ok = ok & icao_matches(_part(line, start, length), length, _part(line, start + length, 1), empty_ok=start == 28)
    return F.coalesce(ok & icao_matches(F.concat(*[_part(line, *p) for p in COMPOSITE]), 39, _part(line, 43, 1)), F.lit(False))


def repaired_zone(line: Column) -> Column:
    """struct(line, changes, state) of a 44-character number line. state: "valid" if all digits
    are right already; "repaired" if every field has one reading with the fewest
    changes and the composite digit confirms them together; else "unrepaired", the
    line as it was and 0 changes."""
    fields = F.array(*[_filled(line, *f) for f in FIELDS])

    def composed(parts: Column) -> Column:
        texts = [F.get(parts, F.lit(i))["text"] for i in range(4)]
        whole = F.concat(texts[0], _part(line, 10, 3), texts[1], _part(line, 20, 1), texts[2], texts[3], as_digit(_part(line, 43, 1)))
        changes = F.aggregate(parts, F.lit(0), lambda n, p: n + p["changes"]) + (as_digit(_part(line, 43, 1)) != _part(line, 43, 1)).cast("int")
        return let(F.struct(whole.alias("line"), changes.alias("changes")), lambda z: F.when(zone_checks(z["line"]), z))

    def state(z: Column) -> Column:
        return F.when(z.isNotNull(), F.struct(z["line"].alias("line"), z["changes"].alias("changes"), F.lit("repaired").alias("state"))).otherwise(
            F.struct(line.alias("line"), F.lit(0).alias("changes"), F.lit("unrepaired").alias("state")))

    found = let(fields, lambda p: F.when(F.forall(p, lambda x: x.isNotNull()), composed(p)))
    return F.when(zone_checks(line), F.struct(line.alias("line"), F.lit(0).alias("changes"), F.lit("valid").alias("state"))).when(
        F.length(line) == 44, let(found, state)).when(
        line.isNotNull(), F.struct(line.alias("line"), F.lit(0).alias("changes"), F.lit("unrepaired").alias("state")))


def _filled(line: Column, start: int, length: int, kind: str) -> Column:
    """A field's reading; a filler may stand for the digit 0 of an empty optional field."""
    data, digit = _part(line, start, length), _part(line, start + length, 1)
    empty = (F.lit(start == 28)) & (digit == "<") & (data == "<" * length)
    return F.when(empty, F.struct(F.concat(data, digit).alias("text"), F.lit(0).alias("changes"))).otherwise(
        repaired_field(data, digit, length, kind))


def repair_zones(df: DataFrame, line: str = "line2") -> DataFrame:
    """Adds `repair`: struct(line, changes, state), see `repaired_zone`; null for a null line."""
    return df.withColumn("repair", repaired_zone(F.col(line)))
