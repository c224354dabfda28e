"""Column expressions shared by the operators."""

from polybag.functions.expressions import (  # noqa: F401
    EPSILON,
    adaptive_threshold,
    bind,
    dot,
    eps_ratio,
    f1_score,
    halve_to_fit,
    hash_key,
    hash_uniform,
    join_numbers,
    l2_normalize,
    label_codes,
    logical_and,
    logical_not,
    logical_or,
    multi_hot,
    pad_array,
    sigmoid,
)
