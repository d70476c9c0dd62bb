from tabulon.functions.exprs import *  # noqa: F401,F403
from tabulon.functions.ranking import (  # noqa: F401
    column_modes,
    exact_quantiles,
    row_index,
    running_sums,
    unpivot_values,
)
