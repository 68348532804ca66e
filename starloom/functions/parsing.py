"""Tolerant reads of JSON fields, on the VARIANT type.

A parsed line is a VARIANT, which tells an absent key from a null one and a JSON number from a numeric string -
a typed ``from_json`` schema can do neither.  No function here ever raises on bad data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numeric text: optional sign, digits with single underscores between them, surrounding blanks.
# Spark's own cast also takes suffixes such as '1d', so text is checked before it is cast.
_DIGITS = r"[0-9]+(_[0-9]+)*"
INT_TEXT = rf"^\s*[+-]?{_DIGITS}\s*$"
FLOAT_TEXT = rf"(?i)^\s*[+-]?(({_DIGITS})?\.?({_DIGITS})(e[+-]?{_DIGITS})?|{_DIGITS}\.(e[+-]?{_DIGITS})?|inf|infinity|nan)\s*$"
_BLANKS = " \t\n\r\f\u000b"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANKS))


def float_text(x: Column, default: float = 0.0) -> Column:
    """Text to DOUBLE, ``default`` for NULL and anything that is not a number."""
    cleaned = F.replace(strip(x), F.lit("_"), F.lit(""))
    parsed = F.when(x.rlike(FLOAT_TEXT), cleaned.try_cast("double"))
    return F.coalesce(parsed, F.lit(float(default)))


def int_text(x: Column, default: int | None = 0) -> Column:
    """Text to BIGINT; '3.0' and '1e3' are not integers and give ``default``."""
    cleaned = F.replace(strip(x), F.lit("_"), F.lit(""))
    parsed = F.when(x.rlike(INT_TEXT), cleaned.try_cast("bigint"))
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("bigint"))


# The same tests as SQL, for expressions that are built as text.
_IS_NUMBER = "RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"
_FALSY = "('[]', '{}', '0', '0.0', 'false')"


class JsonField:
    """One field of a VARIANT column: ``JsonField('doc', 'fans').integer()``.

    Expressions are put together as SQL text: a profile has dozens of fields, and one call per field builds the
    plan much faster than a dozen Column calls.
    """

    def __init__(self, doc: str, name: str):
        self._get = lambda kind: f"try_variant_get({doc}, '$.{name}', '{kind}')"
        self._node = self._get("variant")
        self._kind = f"schema_of_variant({self._node})"
        self._text = self._get("string")

    @property
    def kind(self) -> Column:
        """VOID for null, BIGINT / DECIMAL(..) / DOUBLE, STRING, BOOLEAN, OBJECT<..>, ARRAY<..>; NULL if absent."""
        return F.expr(self._kind)

    @property
    def is_nested(self) -> Column:
        return F.expr(f"coalesce({self._kind} RLIKE '^(OBJECT|ARRAY)', false)")

    def text(self) -> Column:
        return F.expr(self._text)

    def string_only(self) -> Column:
        """The text of a JSON string; NULL for every other JSON type."""
        return F.expr(f"CASE WHEN {self._kind} = 'STRING' THEN {self._text} END")

    def truthy_text(self) -> Column:
        """The text of any value except null, '', 0, false, [] and {}, which give NULL."""
        falsy = f"{self._text} = '' OR ({self._kind} <> 'STRING' AND {self._text} IN {_FALSY})"
        return F.expr(f"CASE WHEN NOT ({falsy}) THEN {self._text} END")

    def floating(self, default: float = 0.0) -> Column:
        return F.expr(
            f"""coalesce(CASE
                WHEN {self._kind} {_IS_NUMBER} THEN {self._get('double')}
                WHEN {self._kind} = 'BOOLEAN' THEN CAST(CAST({self._get('boolean')} AS INT) AS DOUBLE)
                WHEN {self._kind} = 'STRING' AND {self._text} RLIKE r'{FLOAT_TEXT}'
                THEN try_cast(replace({self._text}, '_', '') AS DOUBLE) END, {float(default)}D)"""
        )

    def integer(self, default: int = 0, absent: int | None = None) -> Column:
        """BIGINT; numbers are truncated, ``absent`` (if given) replaces a missing key only."""
        if_absent = "" if absent is None else f"WHEN {self._node} IS NULL THEN {absent}L"
        return F.expr(
            f"""coalesce(CASE {if_absent}
                WHEN {self._kind} {_IS_NUMBER} THEN try_cast({self._get('double')} AS BIGINT)
                WHEN {self._kind} = 'BOOLEAN' THEN CAST({self._get('boolean')} AS BIGINT)
                WHEN {self._kind} = 'STRING' AND {self._text} RLIKE r'{INT_TEXT}'
                THEN try_cast(replace({self._text}, '_', '') AS BIGINT) END, {default}L)"""
        )

    def year(self, default: int = 2000) -> Column:
        """Leading four characters as a year."""
        return int_text(F.expr(f"substring({self._text}, 1, 4)"), default)

    def string_map(self) -> Column:
        """MAP<STRING, VARIANT> of an object; NULL for other types."""
        return F.expr(f"CASE WHEN {self._kind} LIKE 'OBJECT%' THEN {self._get('map<string,variant>')} END")

    def key(self) -> Column:
        """An entity id: '' when absent."""
        return F.expr(f"CASE WHEN {self._node} IS NULL THEN '' ELSE {self._text} END")

    def list_length(self) -> Column:
        """Pieces of a comma-separated text, empty pieces included; 0 for blank, 'None' and falsy values."""
        blank = rf"{self._text} IS NULL OR {self._text} RLIKE r'^\s*(None)?\s*$'"
        falsy = f"{self._kind} <> 'STRING' AND {self._text} IN {_FALSY}"
        return F.expr(f"CAST(CASE WHEN {blank} OR ({falsy}) THEN 0 ELSE size(split({self._text}, ',')) END AS BIGINT)")


def parse_documents(lines: DataFrame) -> DataFrame:
    """Replace ``value`` by ``doc``, a VARIANT; lines that are not a JSON object are dropped.  A table that has ``doc`` already
    stays as it is.

    The document is generated, not projected, so that the filter on it cannot make Spark parse a line twice.
    """
    if "doc" in lines.columns:
        return lines
    objects = lines.where(F.col("value").rlike(r"^\s*\{"))
    rest = [c for c in lines.columns if c != "value"]
    return objects.select(*rest, F.explode(F.expr("array_compact(array(try_parse_json(value)))")).alias("doc"))
