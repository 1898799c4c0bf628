"""Fixed values of the replicate hash and of the Poisson(1) draw, shared with the SQL twins."""
from __future__ import annotations

import math

# Poisson(1) cumulative probabilities P(K <= k), k = 0..11 (rule, not a table).
POISSON1_CDF = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


# Fixed values of the "mix" hash: the 31-bit mask, the two odd multipliers of the
# finaliser and the odd step between replicates. A 31-bit word times any of them stays
# below 2^62, so no 64-bit product overflows (Spark runs with ANSI overflow checks).
MIX_MASK = 0x7FFFFFFF
MIX_MUL1 = 0x045D9F3B
MIX_MUL2 = 0x2C1B3C6D
MIX_STEP = 0x2545F491
# finaliser stages: ("xor", s) is h ^ (h >> s); ("mul", m) is (h * m) & MIX_MASK
FMIX_STAGES = (("xor", 16), ("mul", MIX_MUL1), ("xor", 13), ("mul", MIX_MUL2), ("xor", 16))


def fmix31(h: int) -> int:
    """The finaliser on a Python int (seed constants are folded on the driver)."""
    for op, v in FMIX_STAGES:
        h = h ^ (h >> v) if op == "xor" else (h * v) & MIX_MASK
    return h
