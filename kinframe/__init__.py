"""kinframe: family-tree analytics over whole trees, as PySpark DataFrame operators."""
