"""Camera-motion analytics on Spark: declarative batch plans, their streaming twins, sources and sinks."""

__version__ = "0.1.0"
