"""Typed reads from untrusted JSON held as VARIANT."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import col, filled, let, trim

NUMERIC_TEXT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def parse(text) -> Column:
    """The one JSON value a text consists of, else null.

    The parser stops after the first value, so the text is parsed as an array
    element: anything behind the value is an error there. Only a text with a
    closing bracket could end that array early; it must also fit as a member.
    """
    raw = col(text)
    whole = ~raw.contains("]") | F.try_parse_json(
        F.concat(F.lit('{"v":'), raw, F.lit("}"))
    ).isNotNull()
    return let(
        F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))),
        lambda a: F.when(
            F.try_variant_get(a, "$[1]", "variant").isNull() & whole,
            F.try_variant_get(a, "$[0]", "variant"),
        ),
    )


def parse_object(text) -> Column:
    """The JSON object in a text; null for anything else, valid or not."""
    return let(trim(text), lambda body: F.when(body.startswith("{"), parse(body)))


def at(value, path: str) -> Column:
    """The value at a dotted path. Array elements are not reachable by a dotted path."""
    steps = "".join(f"['{key}']" for key in path.split("."))
    return F.try_variant_get(value, "$" + steps, "variant")


def kind(value) -> Column:
    return F.schema_of_variant(value)


def as_string(value) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_double(value) -> Column:
    return F.try_variant_get(value, "$", "double")


def is_string(value) -> Column:
    return kind(value) == "STRING"


def is_number(value) -> Column:
    return kind(value).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")


def is_object(value) -> Column:
    return kind(value).startswith("OBJECT")


def is_array(value) -> Column:
    return kind(value).startswith("ARRAY")


def number_text(value) -> Column:
    """A number the way a script prints it: no trailing zeros."""
    text = as_string(value)
    return F.when(text.rlike(r"^-?\d+\.\d+$"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


# texts whose JSON type must be looked at: they may be a boolean, an object, an
# array or a number with trailing zeros
UNCLEAR_STARTS = [*"tf[{-0123456789"]
UNCLEAR = r"^(?:true$|false$|[\[{]|-?\d+\.\d*0$)"


def string_at(value, path: str) -> Column:
    """The value at a path as a string, whatever its type."""
    return F.try_variant_get(value, "$" + "".join(f"['{key}']" for key in path.split(".")), "string")


def is_unclear(text) -> Column:
    return F.substring(text, 1, 1).isin(UNCLEAR_STARTS) & text.rlike(UNCLEAR)


def typed_text(value) -> Column:
    """A trimmed non-blank string, or a number as text; null for any other value."""
    return F.when(is_string(value), filled(as_string(value))).when(is_number(value), number_text(value))


def one_text(value, path: str) -> Column:
    return let(
        string_at(value, path),
        lambda s: F.when(is_unclear(s), let(at(value, path), typed_text)).otherwise(filled(s)),
    )


def text_at(value, *paths: str) -> Column:
    """First path that holds a trimmed non-blank string, or a number as text."""
    found = [one_text(value, p) for p in paths]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def object_at(value, path: str) -> Column:
    return let(at(value, path), lambda x: F.when(is_object(x), x))


def truthy(value) -> Column:
    """Script truthiness: absent, null, false, zero and empty text are false."""
    k = kind(value)
    return (
        F.when(value.isNull() | (k == "VOID"), False)
        .when(k == "STRING", as_string(value) != "")
        .when(k == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(is_number(value), as_double(value) != 0)
        .otherwise(True)
    )


def first_value(value, *keys: str) -> Column:
    """First key whose value is neither absent nor null."""
    return F.coalesce(*[F.when(kind(at(value, k)) != "VOID", at(value, k)) for k in keys])


def elements(value) -> Column:
    """Array elements as variants; null when the value is not an array."""
    return F.when(is_array(value), F.try_variant_get(value, "$", "array<variant>"))


def number_millis(number) -> Column:
    n = col(number)
    return F.floor(F.when(n < 1e12, n * 1000).otherwise(n) + F.lit(0.5))


# fixed values: dates other than ISO-8601, with the places of year, month and day
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
WEEKDAY = r"^(?:[A-Za-z]{3,9}\.?,? +)?"
DATE_SHAPES = [
    (WEEKDAY + r"(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?[ -](\d{4})", (3, 2, 1)),
    (WEEKDAY + r"([A-Za-z]{3})[a-z]*\.? +(\d{1,2}),? +(\d{4})", (3, 1, 2)),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
]
CLOCK = (
    r"^(?:[,T ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: *([AaPp])\.?[Mm]\.?)?)?"
    r"(?: *(?:(?:GMT|UTC)?([+-]\d{2}):?(\d{2})|([A-Za-z]{1,4})))?$"
)
ZONE_HOURS = {
    "z": 0, "gmt": 0, "utc": 0, "ut": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6,
    "pst": -8, "pdt": -7,
}


def shaped_millis(text) -> Column:
    """Epoch milliseconds of a date with a month name or slashes, a clock and a zone (UTC without one).

    ``Tue, 17 Feb 2026 11:04:28 GMT``, ``Feb 17, 2026 11:04 PM``, ``2026/02/17 11:04:28``,
    ``2/17/2026``, ``Tue Feb 17 2026 11:04:28 GMT+0100 (CET)``. Other texts, unknown zone
    names and days or hours that do not exist give null.
    """

    def part(value, pattern, group):
        found = F.regexp_extract(value, pattern, group)
        return F.when(found != "", found)

    def split(t):
        dates = []
        for pattern, (year, month, day) in DATE_SHAPES:
            name = F.lower(part(t, pattern, month))
            place = F.array_position(F.array(*[F.lit(m) for m in MONTHS.split()]), name)
            number = F.when(place > 0, place).otherwise(name.try_cast("long"))
            date = F.concat_ws(
                "-", part(t, pattern, year), F.lpad(number.cast("string"), 2, "0"),
                F.lpad(part(t, pattern, day), 2, "0"),
            )
            rest = F.regexp_replace(t, pattern, "")
            found = F.struct(date.alias("date"), rest.alias("rest"))
            dates.append(F.when(t.rlike(pattern) & number.isNotNull(), found))
        return F.coalesce(*dates)

    def joined(found):
        rest = found["rest"]
        hour, half = part(rest, CLOCK, 1).try_cast("int"), F.lower(part(rest, CLOCK, 5))
        hours = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        clock = F.concat_ws(
            ":", F.lpad(F.coalesce(hours, F.when(hour.isNull(), 0)).cast("string"), 2, "0"),
            F.coalesce(part(rest, CLOCK, 2), F.lit("00")), F.coalesce(part(rest, CLOCK, 3), F.lit("00")),
        )
        second = F.unix_millis(F.concat(found["date"], F.lit("T"), clock, F.lit("Z")).try_cast("timestamp"))
        fraction = F.coalesce(F.substring(F.rpad(part(rest, CLOCK, 4), 9, "0"), 1, 3).cast("long"), F.lit(0))
        sign = part(rest, CLOCK, 6).try_cast("int")
        minutes = sign * 60 + F.when(F.substring(part(rest, CLOCK, 6), 1, 1) == "-", -1).otherwise(1) * part(rest, CLOCK, 7).try_cast("int")
        name = F.lower(part(rest, CLOCK, 8))
        zones = F.create_map(*[F.lit(x) for pair in ZONE_HOURS.items() for x in pair])
        offset = F.when(sign.isNotNull(), minutes).when(name.isNotNull(), zones[name] * 60).otherwise(0)
        exists = rest.rlike(CLOCK) & (F.coalesce(hour, F.lit(0)) < 24)
        return F.when(exists, second + fraction - offset * 60_000)

    bare = F.regexp_replace(text, r"\s*\([^()]*\)$", "")
    return let(let(bare, split), joined)


def text_millis(text) -> Column:
    """Epoch milliseconds of a numeric text or a date; a missing zone means UTC."""

    def zoned(t):
        return (
            F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z")))
            .when(t.rlike(r"(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})$"), t)
            .otherwise(F.concat(t, F.lit("Z")))
        )

    def dated(t):
        iso = F.unix_millis(zoned(t).try_cast("timestamp"))
        return F.when(t.rlike(r"^[+-]?\d{4,6}-\d"), iso).otherwise(shaped_millis(t))

    return let(
        trim(text),
        lambda t: F.when(t.rlike(NUMERIC_TEXT), number_millis(t.try_cast("double"))).otherwise(dated(t)),
    )


def millis(value) -> Column:
    """Epoch milliseconds of a JSON number (seconds below 1e12) or text."""
    return F.when(is_number(value), number_millis(as_double(value))).when(
        is_string(value), text_millis(as_string(value))
    )


def millis_at(value, *paths: str) -> Column:
    return F.coalesce(*[let(at(value, p), millis) for p in paths])
