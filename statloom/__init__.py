"""statloom: ready-made analysis operators over Spark DataFrames.

Every operator takes a DataFrame and named parameters and returns a
``ProfileResult`` (result rows, extra tables, metrics), all of them lazy
DataFrames unless the operator has to iterate.
"""

from statloom.result import ProfileResult

__all__ = ["ProfileResult"]
