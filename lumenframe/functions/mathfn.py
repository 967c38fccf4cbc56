"""Probability functions and activations as Column expressions, so that they stay within generated code; and the same in SQL text.

Null in, null out. NaN in, NaN out, unless a function says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The polynomial 7.1.26 of Abramowitz and Stegun for the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Algorithm AS 241 (Wichura) for the normal quantile; numerators and denominators of three regions, lowest power first.
PROBIT_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
PROBIT_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
PROBIT_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
PROBIT_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
PROBIT_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
PROBIT_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Polynomial value, lowest power first."""
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + F.lit(c)
    return out


def horner_sql(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[-1]!r}e0" if "e" not in repr(coefficients[-1]) else repr(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = f"({out} * ({x}) + {c!r}{'' if 'e' in repr(c) else 'e0'})"
    return out


def erf(x: Column) -> Column:
    """Error function, odd, within 1.5e-7; +-1 at infinity."""
    x = x.cast("double")
    t = 1 / (1 + F.lit(ERF_P) * F.abs(x))
    inner = 1 - horner(t, ERF_A) * t * F.exp(-x * x)
    return F.when(x >= 0, inner).otherwise(-inner)


def erf_sql(x: str) -> str:
    t = f"(1 / (1 + {ERF_P} * abs({x})))"
    return f"(CASE WHEN ({x}) >= 0 THEN 1e0 ELSE -1e0 END * (1 - {horner_sql(t, ERF_A)} * {t} * exp(-({x}) * ({x}))))"


def erfc(x: Column) -> Column:
    """1 - erf(x); 0 at infinity and 2 at minus infinity."""
    x = x.cast("double")
    t = 1 / (1 + F.lit(ERF_P) * F.abs(x))
    tail = horner(t, ERF_A) * t * F.exp(-x * x)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + {ERF_P} * abs({x})))"
    tail = f"({horner_sql(t, ERF_A)} * {t} * exp(-({x}) * ({x})))"
    return f"(CASE WHEN ({x}) >= 0 THEN {tail} ELSE 2 - {tail} END)"


def erfinv_coefficients(terms: int) -> list[float]:
    """Of the Maclaurin series of the inverse error function in (sqrt(pi) / 2) * x, odd powers from the first."""
    c = [1.0]
    for k in range(1, terms):
        c.append(sum(c[m] * c[k - 1 - m] / ((m + 1) * (2 * m + 1)) for m in range(k)))
    return [v / (2 * k + 1) for k, v in enumerate(c)]


def erfinv(x: Column, terms: int = 1000) -> Column:
    """Inverse error function by its series; +-inf at +-1, NaN beyond."""
    x = x.cast("double")
    z = x * (math.sqrt(math.pi) / 2)
    series = F.aggregate(F.array(*(F.lit(c) for c in reversed(erfinv_coefficients(terms)))), F.lit(0.0), lambda acc, c: acc * z * z + c) * z
    return F.when(x == 1, F.lit(math.inf)).when(x == -1, F.lit(-math.inf)).when(F.abs(x) > 1, F.lit(math.nan)).otherwise(series)


def erfinv_sql(x: str, terms: int = 1000) -> str:
    z = f"(({x}) * {math.sqrt(math.pi) / 2!r}e0)"
    listed = ", ".join(f"{c!r}" if "e" in repr(c) else f"{c!r}e0" for c in reversed(erfinv_coefficients(terms)))
    return f"(list_reduce([{listed}], lambda acc, c: acc * {z} * {z} + c) * {z})"


def probit(p: Column) -> Column:
    """Normal quantile; -inf at 0 and inf at 1. Raises for p outside [0, 1]."""
    p = p.cast("double")
    q = p - 0.5
    r0 = 0.180625 - q * q
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    near = horner(r - 1.6, PROBIT_C) / horner(r - 1.6, PROBIT_D)
    far = horner(r - 5.0, PROBIT_E) / horner(r - 5.0, PROBIT_F)
    tail = F.when(r <= 5, near).otherwise(far)
    found = F.when(F.abs(q) <= 0.425, q * horner(r0, PROBIT_A) / horner(r0, PROBIT_B)).when(q < 0, -tail).otherwise(tail)
    error = F.raise_error(F.concat(F.lit("probit: illegal input value "), p.cast("string"))).cast("double")
    return F.when((p < 0) | (p > 1), error).when(p == 0, F.lit(-math.inf)).when(p == 1, F.lit(math.inf)).otherwise(found)


def probit_sql(p: str) -> str:
    q, r0, r = f"(({p}) - 0.5e0)", f"(0.180625e0 - (({p}) - 0.5e0) * (({p}) - 0.5e0))", f"sqrt(-ln(least(({p}), 1 - ({p}))))"
    near = f"{horner_sql(f'({r} - 1.6e0)', PROBIT_C)} / {horner_sql(f'({r} - 1.6e0)', PROBIT_D)}"
    far = f"{horner_sql(f'({r} - 5e0)', PROBIT_E)} / {horner_sql(f'({r} - 5e0)', PROBIT_F)}"
    tail = f"(CASE WHEN {r} <= 5 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {horner_sql(r0, PROBIT_A)} / {horner_sql(r0, PROBIT_B)} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x.cast("double")))


def tanh(x: Column) -> Column:
    return F.tanh(x.cast("double"))


def relu(x: Column) -> Column:
    return F.greatest(x.cast("double"), F.lit(0.0))


#: Activations by name.
ACTIVATIONS = {"sigmoid": sigmoid, "tanh": tanh, "relu": relu}


def activation(name: str, x: Column) -> Column:
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name}; known: {', '.join(ACTIVATIONS)}")
    return ACTIVATIONS[name](x)


def softmax(z: Column) -> Column:
    """Of an array of logits, shifted by its maximum."""
    return F.transform(z, lambda v: F.exp(v - F.array_max(z)) / log_sum(z, raw=True))


def log_sum(z: Column, raw: bool = False) -> Column:
    """log(sum(exp(z))) of an array, shifted by its maximum; raw: the shifted sum itself."""
    total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - F.array_max(z)))
    return total if raw else F.log(total) + F.array_max(z)


def clamp(x: Column, most: float) -> Column:
    """x within +-most."""
    return F.least(F.greatest(x, F.lit(-most)), F.lit(most))
