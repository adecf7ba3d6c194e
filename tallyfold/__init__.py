"""Document-question analytics as Spark DataFrame plans."""
