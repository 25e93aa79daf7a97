"""Mixture-model clustering of large tables on Spark: evolved Gaussians, an EM
baseline, threshold search and the scores to compare them."""

from .config import EvolveConfig
from .operators import *  # noqa: F403
from .plans import *  # noqa: F403
from .sources import *  # noqa: F403
from .runtime import held, spread_out
