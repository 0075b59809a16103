"""Column-level helpers: scalar activations and array (matrix) expressions."""

from cellgrad.functions.scalar import (  # noqa: F401
    d_sigmoid, d_sqloss, d_tanh, formula_weight, register_sql_functions,
    sigmoid, tanh, uniform_weight)
