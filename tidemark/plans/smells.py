"""The smell predicates as SQL of their own, for the oracles: written from the definitions, not from the operators."""

SMELLS = {
    "ANY": "(ab <> 0 OR af <> 0 OR lf <> 0)",
    "AB": "(ab >= 1)",
    "AF": "(af >= 1)",
    "LF": "(lf >= 1)",
    "ABorAF": "(greatest(ab, af) >= 1)",
    "ABandAF": "(least(ab, af) >= 1)",
    "ABorLF": "(greatest(ab, lf) >= 1)",
    "ABandLF": "(least(ab, lf) >= 1)",
    "AForLF": "(greatest(af, lf) >= 1)",
    "AFandLF": "(least(af, lf) >= 1)",
    "ANY2": "(list_sum([ab, af, lf]) > 1)",
    "ANY2Distinct": "(len(list_filter([ab, af, lf], lambda n: n > 0)) > 1)",
    "AB2": "(ab > 1)",
    "LF2": "(lf > 1)",
}
