"""Ordered rules: the first predicate that holds gives the label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Production colour names by lightness L, chroma C, a*, and hue angle H in degrees.
COLOUR_RULES = [
    ("Black", "L < 24 AND C < 5.8"),
    ("White", "L >= 65 AND C < 5.0"),
    ("Grey", "L >= 24 AND L < 65 AND C < 5.2"),
    ("Maroon", "(H >= 345 OR H < 24) AND L < 38 AND C >= 6.5 AND a >= 4.5"),
    ("Black", "(H >= 345 OR H < 24) AND L < 24"),
    ("Pink", "(H >= 345 OR H < 24) AND L > 65 AND C < 30"),
    ("Red", "H >= 345 OR H < 24"),
    ("Brown", "H < 58 AND L < 42 AND C >= 5.5"),
    ("Black", "H < 58 AND L < 24"),
    ("Orange", "H < 58"),
    ("Beige", "H < 95 AND L > 50 AND C < 26"),
    ("Black", "H < 95 AND L < 24"),
    ("Yellow", "H < 95"),
    ("Black", "H < 225 AND L < 24 AND C < 5.5"),
    ("Green", "H < 175"),
    ("Cyan", "H < 225"),
    ("Navy", "H < 285 AND L < 36 AND C >= 5.8"),
    ("Black", "H < 285 AND L < 24"),
    ("Blue", "H < 285"),
    ("Maroon", "L < 38 AND C >= 6.5 AND a > 4.5"),
    ("Black", "L < 24"),
    ("Pink", "L > 60"),
    ("Purple", "H < 345"),
]
#: Simplified names with their families, as shade/family.
SIMPLE_RULES = [
    ("Black/Neutral", "C < 5.4 AND L < 24"),
    ("White/Neutral", "C < 5.4 AND L >= 65"),
    ("Grey/Neutral", "C < 5.4"),
    ("Maroon/Red", "(H >= 345 OR H < 25) AND L < 38 AND C >= 6.5 AND a >= 4.5"),
    ("Pink/Red", "(H >= 345 OR H < 25) AND L > 65 AND C < 32"),
    ("Red/Red", "H >= 345 OR H < 25"),
    ("Brown/Orange", "H < 58 AND L < 42"),
    ("Orange/Orange", "H < 58"),
    ("Beige/Yellow", "H < 95 AND L > 45 AND C < 26"),
    ("Yellow/Yellow", "H < 95"),
    ("Olive/Green", "H < 175 AND L < 36 AND C < 22"),
    ("Green/Green", "H < 175"),
    ("Cyan/Cyan", "H < 225"),
    ("Navy/Blue", "H < 285 AND L < 36"),
    ("Blue/Blue", "H < 285"),
    ("Pink/Purple", "L > 65 AND C < 30"),
    ("Purple/Purple", "H < 345"),
]
#: Names by mean hue (0 to 180), saturation and value (0 to 255).
HSV_RULES = [
    ("Black", "V < 50"),
    ("White", "S < 35 AND V > 180"),
    ("Grey", "S < 40"),
    ("Maroon", "(H < 10 OR H >= 170) AND V < 90"),
    ("Pink", "(H < 10 OR H >= 170) AND S < 100 AND V > 160"),
    ("Red", "H < 10 OR H >= 170"),
    ("Brown", "H < 25 AND V < 110"),
    ("Orange", "H < 25"),
    ("Beige", "H < 35 AND S < 80"),
    ("Yellow", "H < 35"),
    ("Green", "H < 85"),
    ("Cyan", "H < 105"),
    ("Navy", "H < 135 AND V < 90"),
    ("Blue", "H < 135"),
    ("Purple", "H < 170"),
]


def first_match(rules: list[tuple[str, str]], otherwise: str) -> Column:
    """One conditional expression over the columns that the predicates name."""
    out = F
    for label, predicate in rules:
        out = out.when(F.expr(predicate), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def first_match_sql(rules: list[tuple[str, str]], otherwise: str) -> str:
    """The same as standard SQL text."""
    return "CASE " + " ".join(f"WHEN {p} THEN '{label}'" for label, p in rules) + f" ELSE '{otherwise}' END"


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue(a: Column, b: Column) -> Column:
    """Hue angle in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))
