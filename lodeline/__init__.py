"""Analytics over project history and training data, as Spark DataFrame plans."""

__version__ = "0.1.0"
