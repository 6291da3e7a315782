"""Vector expressions over ARRAY<FLOAT>, computed in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import col, let


def finite(x) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(0.0))


def total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def normalise(vector) -> Column:
    """Unit vector; a vector without a direction becomes zeros."""

    def scaled(values):
        def by(norm):
            ok = (norm > 0) & (1 / F.when(norm > 0, norm) < float("inf"))
            return F.transform(
                values, lambda x: F.when(ok, x.cast("float") * (1 / norm)).otherwise(0.0).cast("float")
            )

        return let(F.sqrt(total(F.transform(values, lambda x: x * x))), by)

    return let(F.transform(col(vector), lambda x: finite(x.cast("double"))), scaled)


def similarity(a, b) -> Column:
    """Dot product over the shared prefix; a non-finite result is 0."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    products = F.zip_with(
        F.slice(col(a), F.lit(1), n),
        F.slice(col(b), F.lit(1), n),
        lambda x, y: x.cast("double") * y.cast("double"),
    )
    return let(total(products), finite)


def is_zero(vector) -> Column:
    return F.forall(col(vector), lambda x: x == 0)


def is_valid(vector, dims: int) -> Column:
    v = col(vector)
    return (F.size(v) == dims) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
