"""Standard normal distribution in column arithmetic: rational approximations with an error near the last digits of a double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published approximations, highest power first.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PPF_MIDDLE = ((2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
              (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0))
PPF_NEAR = ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
            (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0))
PPF_FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0),
           (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0))


def _column(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_cdf(z: Column | str) -> Column:
    """P(Z <= z); null and NaN give null."""
    z = F.nullif(_column(z), F.lit(float("nan")))
    x = F.when(F.abs(z) > 38, 38.0).otherwise(F.abs(z))
    density = F.exp(-x * x / 2)
    tail = x + 0.65
    for k in (4, 3, 2, 1):
        tail = x + F.lit(float(k)) / tail
    upper = F.when(x < 7.07106781186547, density * _polynomial(CDF_TOP, x) / _polynomial(CDF_BOTTOM, x)).otherwise(density / tail / 2.506628274631)
    upper = F.when(F.abs(z) > 38, 0.0).otherwise(upper)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def norm_ppf(p: Column | str) -> Column:
    """The quantile of p in (0, 1); anything else gives null."""
    p = _column(p)
    q = p - 0.5
    middle = F.lit(0.180625) - q * q
    low = F.least(p, 1 - p)
    r = F.sqrt(-F.log(F.when(low > 0, low)))

    def ratio(pair, x: Column) -> Column:
        return _polynomial(pair[0], x) / _polynomial(pair[1], x)

    outer = F.when(r <= 5, ratio(PPF_NEAR, r - 1.6)).otherwise(ratio(PPF_FAR, r - 5.0))
    value = F.when(F.abs(q) <= 0.425, q * ratio(PPF_MIDDLE, middle)).otherwise(F.signum(q) * outer)
    return F.when((p > 0) & (p < 1), value)
