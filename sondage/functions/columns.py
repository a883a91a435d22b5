"""Column-level building blocks shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
ATOMIC = NUMERIC + DATES + (T.StringType, T.BooleanType)


def quoted(name: str) -> Column:
    """Column by literal name (dots and spaces are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns by physical type, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def atomic_columns(df: DataFrame) -> list[str]:
    """Columns the profiling operators look at; nested ones pass through untouched."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ATOMIC)]


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_double(c: Column) -> Column:
    """Double with NaN read as missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def present(df: DataFrame, name: str) -> Column:
    """Column by name with NaN read as missing, in its own type."""
    c = quoted(name)
    return F.when(~F.isnan(c), c) if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)) else c


def as_text(df: DataFrame, name: str) -> Column:
    """Display text of a value; dates at midnight print as dates do in SQL casts."""
    return quoted(name).cast("string")


def skew_g1(g: Column, n: Column, var: Column) -> Column:
    """Bias-corrected skewness from the population one; NULL for fewer than three values or no spread."""
    return F.when((n > 2) & (var > 0), g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurt_g2(k: Column, n: Column, var: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; NULL for fewer than four values or no spread."""
    scaled = ((n + 1) * k + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n > 3) & (var > 0), scaled)


def band(c: Column, thresholds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first threshold (given high to low) that ``c`` exceeds; NULL stays NULL."""
    out = F.lit(otherwise)
    for limit, label in reversed(list(thresholds)):
        out = F.when(c > F.lit(limit), F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def clamp(c: Column, low: float, high: float) -> Column:
    """Clip to [low, high], keeping NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


def clean_nan(df: DataFrame) -> DataFrame:
    """Read NaN as missing in every floating-point column, in one projection."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


# ------------------------------------------------------------------ normal distribution

# Cody's (1969) rational approximations of the error function, by falling powers, near zero, up to 4 and beyond.
_ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
_ERF_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
_ERFC_NUM = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
             8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
_ERFC_DEN = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
             3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3]
_TAIL_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
_TAIL_DEN = [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]

# Wichura's (1988) rational approximations of the inverse normal, by falling powers, in the middle, in the tails and far out.
PPF_MIDDLE = (
    [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4,
     1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0],
    [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3,
     6.8718700749205790830e2, 4.2313330701600911252e1, 1.0],
)
PPF_TAIL = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0,
     5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1,
     1.67638483018380384940e0, 2.05319162663775882187e0, 1.0],
)
PPF_FAR = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1,
     1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2,
     1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0],
)


def _power_sum(coef: Sequence[float], x: Column) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to about 1e-15."""
    t = F.abs(z) / F.lit(2.0**0.5)
    near = z / F.lit(2.0**0.5) * _power_sum(_ERF_NUM, t * t) / _power_sum(_ERF_DEN, t * t)  # the error function itself
    tail = F.exp(-t * t) * _power_sum(_ERFC_NUM, t) / _power_sum(_ERFC_DEN, t)
    u = F.lit(1.0) / (t * t)
    far = F.exp(-t * t) / t * (F.lit(0.5641895835477562869) - u * _power_sum(_TAIL_NUM, u) / _power_sum(_TAIL_DEN, u))
    rest = F.when(t > 27.0, F.lit(0.0)).when(t > 4.0, far).otherwise(tail) / 2
    return F.when(t <= 0.46875, 0.5 + near / 2).when(z < 0, rest).otherwise(1 - rest)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, for 0 < p < 1, to about 1e-15."""
    q = p - 0.5
    middle = F.lit(0.180625) - q * q
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    ratio = lambda parts, x: _power_sum(parts[0], x) / _power_sum(parts[1], x)
    outer = F.when(r <= 5.0, ratio(PPF_TAIL, r - 1.6)).otherwise(ratio(PPF_FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * ratio(PPF_MIDDLE, middle)).otherwise(F.signum(q) * outer)
