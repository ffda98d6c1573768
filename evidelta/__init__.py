"""evidelta: a PySpark-native engine for evidence regression and training-data processing.

The package is split into ``sources`` (readers and writers), ``functions`` (Column
libraries and Arrow-batched Python functions), ``operators`` (DataFrame to DataFrame),
``plans`` (named queries and their SQL counterparts), ``streaming`` (the gate on a stream) and ``llm``,
which holds the operators for language-model training data.
"""

__version__ = "0.1.0"
