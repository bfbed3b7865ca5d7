"""Stateless operators on streams.

Audits, corrections and fitted preprocessing are projections with literal parameters, so they apply
to a streaming DataFrame as to any other; this module only names the common chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.prep import Preprocessor
from ..operators.rules import Rule, clamp_correction


def corrected_and_encoded(stream: DataFrame, given: list[Rule], fitted: Preprocessor, passes: int = 1) -> DataFrame:
    """Rules applied, then the fitted preprocessing: one projection per micro-batch, no state."""
    return fitted.transform(clamp_correction(stream, given, passes))
