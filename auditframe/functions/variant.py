"""VARIANT helpers: Python-style truthiness and strict JSON type tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe.functions import let
from auditframe.functions.text import has_visible


def vtype(v: Column) -> Column:
    """Upper-case type name of a VARIANT value (``VOID`` for JSON null,
    NULL when the value is absent)."""
    return F.schema_of_variant(v)


def truthy(v: Column) -> Column:
    """Python ``bool(value)`` of a decoded JSON value held in a VARIANT.

    Absent / null -> false; booleans -> their value; strings -> non-empty;
    arrays / objects -> non-empty; numbers -> non-zero.
    """

    def body(x: Column) -> Column:
        t = vtype(x)
        return (
            F.when(x.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
            .when(t == "STRING", F.length(F.try_variant_get(x, "$", "string")) > 0)
            .when(t.startswith("ARRAY"), F.to_json(x) != "[]")
            .when(t.startswith("OBJECT"), F.to_json(x) != "{}")
            .otherwise(F.coalesce(F.try_variant_get(x, "$", "double") != 0, F.lit(True)))
        )

    return let(v, body)


def field(v: Column, name: str) -> Column:
    """Member ``name`` of a VARIANT object (NULL when absent or not an object)."""
    return F.try_variant_get(v, f"$.{name}", "variant")


# The tests below ask for the type of ``v`` unless its name ``kind`` is at hand.


def _kind(v: Column, kind: Column | None) -> Column:
    return vtype(v) if kind is None else kind


def is_object(v: Column, kind: Column | None = None) -> Column:
    return F.coalesce(_kind(v, kind).startswith("OBJECT"), F.lit(False))


def is_array(v: Column, kind: Column | None = None) -> Column:
    return F.coalesce(_kind(v, kind).startswith("ARRAY"), F.lit(False))


def has_field(v: Column, name: str) -> Column:
    """True when the object has the key (a JSON null member counts as present).
    What is no object has no member, so its type is not asked for."""
    return field(v, name).isNotNull()


def is_string(v: Column, kind: Column | None = None) -> Column:
    return F.coalesce(_kind(v, kind) == "STRING", F.lit(False))


def is_bool(v: Column, kind: Column | None = None) -> Column:
    return F.coalesce(_kind(v, kind) == "BOOLEAN", F.lit(False))


def is_integer(v: Column, kind: Column | None = None) -> Column:
    """JSON integer (not boolean, not fraction)."""
    t = _kind(v, kind)
    return F.coalesce(
        t.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | t.rlike(r"^DECIMAL\(\d+,0\)$"), F.lit(False)
    )


def is_number(v: Column, kind: Column | None = None) -> Column:
    t = _kind(v, kind)
    return F.coalesce(
        t.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | t.startswith("DECIMAL"),
        F.lit(False),
    )


def string_value(v: Column, kind: Column | None = None) -> Column:
    return F.when(is_string(v, kind), F.try_variant_get(v, "$", "string"))


def nonblank(v: Column, kind: Column | None = None, text: Column | None = None) -> Column:
    """A string that holds more than white space; never NULL. ``text`` is its
    ``string_value`` where that is a column."""
    if text is None:
        return F.coalesce(has_visible(string_value(v, kind)), F.lit(False))
    return F.coalesce((text >= F.lit("!")) & (text < F.lit("\u007f")) | has_visible(text), F.lit(False))


def json_text(v: Column, kind: Column, s: Column) -> Column:
    """``to_json`` of a value whose type name and ``string_value`` are at hand. Spark sets up a JSON writer for
    every string and key of a VARIANT; a text without anything to escape, and a list of
    texts, need none."""
    return (
        F.when((kind == "STRING") & ~s.rlike(r'["\\\x00-\x1f]'), F.concat(F.lit('"'), s, F.lit('"')))
        .when(kind == "ARRAY<STRING>", F.to_json(F.try_variant_get(v, "$", "array<string>"))).otherwise(F.to_json(v)))


def object_text(members: Column, texts: dict[str, Column]) -> Column:
    """``to_json`` of an object: ``members`` as a map, and the JSON ``texts`` of some of
    them (plain names, all there). NULL where another name is not plain."""
    rest = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*texts))
    plain = F.forall(rest, lambda e: e["key"].rlike("^[A-Za-z0-9_]+\\z"))
    given = F.transform(rest, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(e["value"])))
    known = F.array(*[F.concat(F.lit(f'"{name}":'), text) for name, text in texts.items()])
    # the quote behind a plain name sorts in front of all that a longer name goes on with
    return F.when(plain, F.concat(F.lit("{"), F.array_join(F.sort_array(F.concat(known, given)), ","), F.lit("}")))
