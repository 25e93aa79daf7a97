from .evolve import evolve, generation
from .experiments import (
    best_deltas,
    compare_algorithms,
    delta_grid,
    delta_search,
    describe_scores,
    long_scores,
    mean_scores,
    replicates,
    sorted_results,
)
from .predict import predict, predicted_scores, representatives

__all__ = [
    "best_deltas",
    "compare_algorithms",
    "delta_grid",
    "delta_search",
    "describe_scores",
    "evolve",
    "generation",
    "long_scores",
    "mean_scores",
    "predict",
    "predicted_scores",
    "replicates",
    "representatives",
    "sorted_results",
]
