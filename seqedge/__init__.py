"""seqedge: Spark table operators for predicting edges between DNA sequences.

Every operator takes and returns DataFrames and is written with built-in
column expressions so Catalyst plans it; Python runs only inside
``mapInPandas`` for user models (``operators.scoring.score_pairs``).
"""

from seqedge.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
