"""Query catalogue; importing a module registers its queries."""
from . import (block_queries, calibration_queries, distribution_queries, fine_queries, frame_queries,  # noqa: F401
               product_queries, stack_queries, trial_queries)
