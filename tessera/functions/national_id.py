"""Spanish national identity number (DNI / NIE) check as native Column
expressions, plus a SQL function of the same check for SQL users.

Two variants exist because the two published custom rules disagree:

* ``national_id_ok_strict`` -- NULL, wrong length, non-digits or a
  non-letter control character all fail; a leading X/Y/Z (foreigner id)
  stands for 0/1/2. The verdict is never NULL.
* the SQL function -- lenient: X/Y/Z stand for digits anywhere in the first
  eight characters; a digit part that is not a number gives a NULL verdict,
  and a NULL verdict passes.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Control letters indexed by (number mod 23), as defined for
# the Spanish DNI/NIE, and the NIE prefix letters standing for 0, 1, 2.
CONTROL_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NIE_PREFIX_DIGITS = {"X": "0", "Y": "1", "Z": "2"}

SQL_FUNCTION_NAME = "is_valid_nif_es"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _control_letter(number: Column) -> Column:
    return F.substring(F.lit(CONTROL_LETTERS), (number % 23 + 1).cast("int"), 1)


def national_id_ok_strict(c) -> Column:
    """TRUE when the value is a valid DNI/NIE; FALSE otherwise (never NULL).

    The value is referenced three times only (shape, number, letter), so a
    large input expression inlined by the optimizer stays within codegen.
    """
    raw = F.upper(F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", ""))
    prefixes = "".join(NIE_PREFIX_DIGITS)
    shaped = raw.rlike(rf"^[{prefixes}0-9][0-9]{{7}}\p{{L}}$")
    # the shape admits a prefix letter in position 1 only, so translating
    # the first eight characters maps exactly that position
    number = F.translate(F.substring(raw, 1, 8), prefixes, "".join(NIE_PREFIX_DIGITS.values())).cast("long")
    verdict = F.when(shaped, _control_letter(number) == F.substring(raw, 9, 1))
    return F.coalesce(verdict, F.lit(False))


def register_sql_function(spark: SparkSession, name: str = SQL_FUNCTION_NAME) -> str:
    """Register the lenient check as a temporary SQL function ``name(STRING)``.

    SQL functions are inlined into the plan by the analyzer, so calling it
    from a filter stays inside whole-stage codegen.
    """
    letters, digits = "".join(NIE_PREFIX_DIGITS), "".join(NIE_PREFIX_DIGITS.values())
    body = f"try_cast(translate(upper(left(trim(v), 8)), '{letters}', '{digits}') AS INT)"
    # place of the expected letter; a negative remainder counts from the end
    place = f"pmod({body} % 23 + CAST({body} < 0 AS INT), 23)"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS BOOLEAN
        RETURN char_length(coalesce(trim(v), '')) = 9
               AND locate(upper(right(trim(v), 1)), '{CONTROL_LETTERS}') = {place} + 1
    """)
    return name
