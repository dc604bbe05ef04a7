from churnlens.functions.columns import (  # noqa: F401
    day_int, epoch_millis, hash_unit, hash_u32, millis_to_date, euclidean, flag,
)
from churnlens.functions.ranking import ordinal_within, rank_within, exact_median  # noqa: F401
