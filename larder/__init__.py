"""larder: recipe nutrition analytics and corpus preparation on PySpark."""
