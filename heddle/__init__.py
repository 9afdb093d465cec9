"""heddle: hierarchical record flows as Spark DataFrames.

Sources, record-stream operators, the hierarchical integrate join, scalar
functions, sinks and the general data-processing operators live here; the
subpackage ``llm`` holds the text operators and is imported by nobody else.
"""

__version__ = "0.1.0"
