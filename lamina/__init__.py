"""Document-package and corpus analytics expressed as Spark plans."""
