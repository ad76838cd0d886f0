"""Rule-based relational analytics and training-data operators on PySpark."""
