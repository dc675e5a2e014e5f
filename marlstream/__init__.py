"""marlstream: content-transformation and analytics operators as Spark DataFrame plans."""
