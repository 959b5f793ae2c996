"""Image analytics and training-data operators as PySpark DataFrame transformations."""
