"""quadrille: spatial-measurement analytics as PySpark DataFrame plans."""
