"""String functions over molecule and reaction text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_lines(text: Column) -> Column:
    """Trimmed lines that are neither blank nor comments."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))


def components(text: Column) -> Column:
    """Trimmed parts between dots, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\."), lambda x: F.trim(x)), lambda x: x != "")


def longest(parts: Column) -> Column:
    """The longest text of an array, the first of equal ones; null for an empty array."""
    return F.array_max(F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]


def sorted_join(parts: Column) -> Column:
    return F.array_join(F.array_sort(parts), ".")


def reaction_text(reactants: Column, product: Column) -> Column:
    return F.concat(F.array_join(reactants, "."), F.lit(">>"), product)


def retro_text(product: Column, reactants: Column) -> Column:
    return F.concat(product, F.lit(">>"), F.array_join(reactants, "."))


def parse_reaction(s: Column) -> Column:
    """Struct of left, agents and right components; null unless the text has two or three parts."""
    two = F.split(s, ">>")
    three = F.split(s, ">")
    return F.when((F.size(two) == 2) & (F.size(three) == 3) & (F.get(three, 1) == ""), F.struct(components(F.get(two, 0)).alias("left"), F.array().cast("array<string>").alias("agents"), components(F.get(two, 1)).alias("right"))).when(
        F.size(three) == 3, F.struct(components(F.get(three, 0)).alias("left"), components(F.get(three, 1)).alias("agents"), components(F.get(three, 2)).alias("right"))
    )


def is_simplifying(smarts: Column) -> Column:
    """One non-empty part on the left of the pattern and two or more on the right."""
    sides = F.split(smarts, ">>")
    n = lambda i: F.size(components(F.get(sides, i)))
    return (F.size(sides) == 2) & (n(0) == 1) & (n(1) >= 2)


def one_hot(value: Column, known: list, other: bool = True) -> Column:
    """Indicator array; what isn't known sets the last place, or none."""
    flags = [F.when(value == F.lit(k), 1).otherwise(0) for k in known]
    return F.array(*flags, *([F.when(value.isin(known), 0).otherwise(1)] if other else []))


def dual_features(r: Column, p: Column) -> Column:
    """[r, p, p - r, p * r] of two vectors."""
    return F.concat(r, p, F.zip_with(p, r, lambda a, b: a - b), F.zip_with(p, r, lambda a, b: a * b))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero; a zero keeps the sign of x, which F.round drops and IEEE 754 and SQL engines keep."""
    out = F.round(x, digits)
    return F.when(out == 0, x * F.lit(0.0)).otherwise(out)


def conditions_empty(conditions: Column) -> Column:
    """Whether a reaction's conditions (solvent, temperature_c, reagent, extra map) say nothing; a null record says nothing."""
    named = [conditions[c].isNull() for c in ("solvent", "temperature_c", "reagent")]
    extra = F.coalesce(F.size(conditions["extra"]), F.lit(0)) <= 0
    return conditions.isNull() | (named[0] & named[1] & named[2] & extra)
