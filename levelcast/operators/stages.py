"""Computing a costly expression exactly once.

The optimizer merges projections and pushes filters through them by copying the
expressions they refer to. For a parsed document that is read by dozens of
expressions this would parse it dozens of times. A generator of exactly one row
is a step the optimizer does not copy across; it stays inside code generation.
"""

from pyspark.sql import functions as F


def compute_once(df, keep=None, **columns):
    """Add columns that later steps can refer to without recomputing them."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = df.columns if keep is None else keep
    return df.select(*kept, F.inline(F.array(row)))
