"""lodestrata: a PySpark-native engine for code-corpus and text analytics.

DataFrame in, DataFrame out: every operator declares a logical plan and leaves
the physical strategy to Catalyst; Python workers are used only where a fold
or a parser has no built-in expression.
"""

__version__ = "0.1.0"
