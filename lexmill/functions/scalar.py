"""The closed-form domain scalar S = K (T1 + T2 + T3), as pure Column expressions over doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seed constants, and what follows from them.
PI, E = math.pi, math.e
PHI = (1 + math.sqrt(5)) / 2
GAMMA = 0.5772156649015329
CATALAN = 0.915965594177219
ALPHA = math.log(PI) / (E * PHI**13)
PSI = 1 - 1 / E
ETA = 1 / (PI - 1)
BETA = math.exp(-(PI**PI + (E - 1)))
THETA = math.sin(PSI * ETA)
POOF = math.exp((-math.log(PI) / E) / (ETA * math.log(PHI)))
C_EFF = (1 - POOF * math.sin(THETA)) * (1 + 0.01 * CATALAN / (PI * PHI))
BLEED = math.sin(PI / E) * PHI / math.sqrt(2)
P_VAR = -math.cos(THETA + PI)
B_IN = C_EFF * (1 - math.sin(THETA) / PHI)
A_IN = BLEED * (1 + math.cos(THETA) / PHI)
SUCTION = POOF * (-math.cos(THETA - PI))
CHAOS = (-math.log(2) / PHI) / (math.sin(PI / E) * math.sqrt(2))
P_NEW = GAMMA / E * math.sqrt(2)
C_FACTOR = C_EFF * P_NEW
K = PHI * (GAMMA / E) * math.sqrt(2) / math.log(PI) * 0.99

DEFAULTS = {
    "n": 1.0, "p": 1.0, "d_eff": 25.0, "hits": 0.0, "dpsi": 1.0, "dtheta": 1.0, "rho": 1.0, "scale": 1.0,
    "amplitude": 1.0, "bias": 0.0, "observed": False,
}


def panel(**given: Column | float | bool) -> dict[str, Column]:
    """growth, qm, t1, t2, t3 and s; inputs not given have the defaults above."""
    x = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (DEFAULTS | given).items()}
    share = x["hits"] / x["n"]
    mass = x["n"] * x["p"] / F.sqrt(x["d_eff"])
    growth = F.exp(ALPHA * (1 - share) * GAMMA / PHI)
    base = mass * F.cos((PSI + x["dpsi"]) / ETA) * F.exp(-ALPHA * share + x["rho"] + B_IN * x["dpsi"]) * (1 + growth * C_EFF)
    qm = F.when(x["observed"], math.exp(C_FACTOR * P_VAR) * F.cos(x["dpsi"] + P_VAR)).otherwise(F.lit(1.0))
    t1 = base * (1 + P_NEW * F.ln(x["d_eff"] / 25)) * qm
    t2 = x["scale"] * x["amplitude"] + x["bias"]
    valve = BETA * F.cos(x["dpsi"]) * mass * (1 + CHAOS * (x["d_eff"] - 25) / 25) * (1 + POOF * math.cos(THETA + PI) + SUCTION * math.sin(THETA))
    sound = 1 + BLEED * F.pow(F.sin(x["dtheta"]), F.lit(2)) / PHI + A_IN * F.pow(F.cos(x["dtheta"]), F.lit(2)) / PHI
    t3 = valve * sound * (1 + B_IN * P_VAR)
    return {"growth": growth, "qm": qm, "t1": t1, "t2": t2, "t3": t3, "s": K * (t1 + t2 + t3)}


def golden_series(values: Column) -> Column:
    """Sum of v_i / phi^i over the sum of 1 / phi^i."""
    weights = F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.pow(F.lit(PHI), -i))
    top = F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return top / F.greatest(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), F.lit(1e-15))


def seeded_dimension(name: Column) -> Column:
    """A dimension in [6, 24] folded from the code points of a name; depends on nothing else."""
    chars = F.filter(F.split(F.lower(name), ""), lambda c: c != "")
    folded = F.aggregate(
        F.transform(chars, lambda c, i: (F.ascii(c) + 1) * F.pow(F.lit(PHI), (i % 7 + 1).cast("double"))),
        F.lit(0.0),
        lambda h, x: (h + x) % 1000.0,
    )
    return F.round(6.0 + folded / 1000.0 * 18.0, 2)
