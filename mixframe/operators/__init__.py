from .assignment import assign, assignment_cells, nearest_labels, relabel_dense
from .fitness import fitness, point_distances
from .leaders import close_pairs, leaders, refine
from .matching import nearest, nearest_by_window, pair_distances, select
from .metrics import adjusted_rand, cluster_scores, contingency, label_count, scores
from .mixture import (
    assemble,
    component_ellipse,
    em_cells,
    em_fit,
    em_predict,
    fit_mixture,
    gmm_step,
    kmeans_start,
    mixture_components,
    model_vectors,
    predict_mixture,
)
from .population import init_population, partners, sample_points, vary
from .scaling import bounds, domain, minmax_scale, zscore_scale

__all__ = [
    "adjusted_rand",
    "assemble",
    "assign",
    "assignment_cells",
    "bounds",
    "close_pairs",
    "cluster_scores",
    "component_ellipse",
    "contingency",
    "domain",
    "em_cells",
    "em_fit",
    "em_predict",
    "fit_mixture",
    "fitness",
    "gmm_step",
    "init_population",
    "kmeans_start",
    "label_count",
    "leaders",
    "minmax_scale",
    "mixture_components",
    "model_vectors",
    "nearest",
    "nearest_by_window",
    "nearest_labels",
    "pair_distances",
    "point_distances",
    "partners",
    "predict_mixture",
    "refine",
    "relabel_dense",
    "sample_points",
    "scores",
    "select",
    "vary",
    "zscore_scale",
]
