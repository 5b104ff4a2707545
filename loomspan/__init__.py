"""loomspan: a declarative, policy-aware query engine expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
