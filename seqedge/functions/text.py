"""Text column expressions: GTF attributes, id lists, run names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def gtf_attribute(attrs, name: str) -> Column:
    """Value of ``name "..."`` in a GTF attribute field, NULL if absent."""
    pattern = re.escape(name) + r' "([^"]+)"'
    return F.nullif(F.regexp_extract(_c(attrs), pattern, 1), F.lit(""))


def split_ids(col, sep: str = ",") -> Column:
    """Comma list -> array of trimmed, non-empty ids."""
    parts = F.transform(F.split(_c(col), re.escape(sep)), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != F.lit(""))


def run_name(class_weights, downsample_rate, accumulation) -> Column:
    """``batching-cw_<w0>_<w1>-dsr_<rate>-gas_<steps>``.

    ``class_weights`` is the bracketed text (``[0.1,1.0]``): commas become
    underscores and brackets are dropped, as the sweep names its runs.
    """
    cw = F.translate(F.regexp_replace(_c(class_weights), ",", "_"), "[]", "")
    return F.concat(F.lit("batching-cw_"), cw, F.lit("-dsr_"), _c(downsample_rate).cast("string"),
                    F.lit("-gas_"), _c(accumulation).cast("string"))
