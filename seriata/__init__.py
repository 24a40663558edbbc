"""seriata: time-series panels kept as long tables, as plain PySpark.

Every operator is a function from DataFrames to a DataFrame.  Nothing runs
until the caller asks for rows, except where a docstring says otherwise.
"""

__version__ = "0.1.0"
