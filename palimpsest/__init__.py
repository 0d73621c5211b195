"""palimpsest: a Spark-first engine for long-lived, fact-bearing text memories.

The subpackages hold expressions (``functions``), DataFrame operators
(``operators``), readers and writers (``sources``), composed query plans
(``plans``) and micro-batch jobs (``streaming``).
"""

__version__ = "0.1.0"
