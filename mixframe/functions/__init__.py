from .distance import prefixed, scaled_sq_distance
from .rng import digest, hash_below, uniform

__all__ = [
    "digest",
    "hash_below",
    "prefixed",
    "scaled_sq_distance",
    "uniform",
]
