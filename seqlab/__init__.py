"""seqlab: ordered-record analytics expressed as Spark DataFrame plans.

Rows follow a position axis (a chainage, a timestamp).  The library labels rows
from interval tables, numbers contiguous runs of a label, measures spacing and
coverage, bins rows to a grid, cleans and splits them reproducibly, and scores
classifiers under an asymmetric cost matrix.  Global-order work runs as a
block-wise scan (``operators.order``) and every random choice is a hash rank
(``operators.sampling``), so results are independent of partitioning.
"""

from seqlab.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
