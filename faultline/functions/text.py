"""Small string expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the characters a trim removes
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    A lambda variable cannot be inlined by the optimizer, so a costly value is
    computed one time per row however often the body mentions it.
    """
    return F.transform(F.array(value), body)[0]


def trim(value) -> Column:
    return F.btrim(col(value), F.lit(WHITESPACE))


def filled(value) -> Column:
    """Trimmed text, or null when nothing is left."""
    text = trim(value)
    return F.when(text != "", text)


def present(value) -> Column:
    """The text itself, or null when it is empty."""
    return F.when(col(value) != "", col(value))


def collapse_spaces(value) -> Column:
    return trim(F.regexp_replace(col(value), SPACE_CLASS + "+", " "))


def clip(value, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends with an ellipsis."""
    text = col(value)
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    ).otherwise(text)


def one_line(value, limit: int) -> Column:
    return let(collapse_spaces(F.coalesce(col(value), F.lit(""))), lambda t: clip(t, limit))


def cap(value, limit: int) -> Column:
    """Trimmed text cut at ``limit`` with a visible marker."""
    return let(
        trim(F.coalesce(col(value), F.lit(""))),
        lambda t: F.when(
            F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("\n…[truncated]"))
        ).otherwise(t),
    )


def days_ago(epoch_ms, now_ms: int) -> Column:
    at = col(epoch_ms)
    days = F.floor((F.lit(now_ms) - at) / F.lit(86_400_000))
    return (
        F.when(at.isNull() | (at == 0), "unknown date")
        .when(days <= 0, "today")
        .when(days == 1, "1 day ago")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def fixed(value, digits: int) -> Column:
    """A number with exactly ``digits`` decimals and no grouping."""
    return F.format_string(f"%.{digits}f", col(value))
