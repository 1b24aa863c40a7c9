"""tessera: rule-driven data validation on Spark DataFrames.

Tables, rules and validations are kept as data (config DataFrames). A run
evaluates every active validation of a table as DataFrame operations -- all
row-level rules of a table in one scan -- writes failing records as evidence
rows, one result row per validation, and classifies each failure as new,
persistent or resolved against the previous run of the same table.
"""

from tessera.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
