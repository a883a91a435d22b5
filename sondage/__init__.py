"""sondage: table profiling, cleaning, statistics and modelling as Spark DataFrame operators.

Every operator takes and returns DataFrames.  Work is declared with the
DataFrame API so that Catalyst plans it; the driver only ever holds
schema-sized facts (O(columns)) or a sample of fixed size.
"""

from sondage.session import build_session, settings

__all__ = ["build_session", "settings"]
