"""Arguments of calls, given as JSON, against a schema: what is missing or of another kind, and the values made clean."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Argument:
    """A name, its kind (string, number or integer), and whether a call must have it."""

    name: str
    kind: str = "string"
    required: bool = False


#: What Spark calls the kinds of JSON values; whole numbers beyond 64 bits are decimals without places.
WHOLE, NUMERIC = r"^(BIGINT|DECIMAL\(\d+,0\))$", r"^(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))$"
SAID = {"string": "text", "number": "a number", "integer": "a whole number"}


def value_of(call: Column, name: str) -> tuple[Column, Column]:
    """The kind of an argument (null where the call hasn't it, VOID for null) and its text."""
    path = F.lit("$['" + name.replace("'", "\\'") + "']")
    return F.schema_of_variant(F.try_variant_get(call, path, "variant")), F.try_variant_get(call, path, "string")


def fits(kind: Column, text: Column, wanted: str) -> Column:
    """Numbers given as text are taken; booleans are no numbers, though they may stand for text."""
    if wanted == "number":
        return kind.rlike(NUMERIC) | ((kind == "STRING") & text.try_cast("double").isNotNull())
    if wanted == "integer":
        return kind.rlike(WHOLE) | ((kind == "STRING") & text.rlike(r"^\d+$"))
    return kind.rlike(NUMERIC) | kind.isin("STRING", "BOOLEAN")


def problem(json: Column, schema: Sequence[Argument]) -> Column:
    """'' for a call that fits, else what to say: all that is missing, or the first argument in the call's order that is of another kind.

    Text that isn't an object of JSON misses all that is required. Arguments that the schema hasn't are passed over.
    """
    call = F.try_parse_json(json)
    facts = [(a, *value_of(call, a.name)) for a in schema]
    lacks = lambda kind, text: kind.isNull() | (kind == "VOID") | ((kind == "STRING") & (F.trim(text) == ""))
    missing = F.filter(F.array(*[F.when(lacks(kind, text), F.lit(a.name)) for a, kind, text in facts if a.required] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    place = lambda a: F.array_position(F.json_object_keys(json), F.lit(a.name))
    wrong = [F.when(kind.isNotNull() & ~F.coalesce(fits(kind, text, a.kind), F.lit(False)), F.struct(place(a).alias("at"), F.lit(f"{a.name} must be {SAID[a.kind]}").alias("said"))) for a, kind, text in facts]
    first = F.array_min(F.filter(F.array(*wrong), lambda x: x.isNotNull()))["said"]
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise(F.coalesce(first, F.lit("")))


def cleaned(json: Column, schema: Sequence[Argument]) -> Column:
    """A struct of the schema's arguments: text without blanks around it, numbers, and whole numbers cut off; 0 where a number can't be read, null where a call hasn't the argument."""
    call = F.try_parse_json(json)

    def of(a: Argument) -> Column:
        kind, text = value_of(call, a.name)
        if a.kind == "string":
            return F.trim(text).alias(a.name)
        number = F.when(kind.rlike(NUMERIC) | (kind == "STRING"), text.try_cast("double"))
        if a.kind == "integer":
            number = F.when(kind.rlike(NUMERIC) | text.rlike(r"^\s*[+-]?\d+\s*$"), F.coalesce(F.trim(text).try_cast("long"), number.try_cast("long")))
        return F.when(kind.isNotNull(), F.coalesce(number, F.lit(0).cast("long" if a.kind == "integer" else "double"))).alias(a.name)

    return F.struct(*map(of, schema))
