"""zygospark: set-oriented genotype analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; nothing is collected
to the driver and no Python runs per row.  See README.md for the layout.
"""

__version__ = "0.1.0"
