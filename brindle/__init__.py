"""brindle: instance-based and online stream mining expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
