"""The four jobs: forest markers and the binary, multiclass and continuous nets."""

from markerloom.plans.forest_markers import ForestMarkers, find_markers, resume_from_rules
from markerloom.plans.nets import NetResult, binary_net, continuous_net, multiclass_net

__all__ = [
    "ForestMarkers",
    "NetResult",
    "binary_net",
    "continuous_net",
    "find_markers",
    "multiclass_net",
    "resume_from_rules",
]
