"""evograph: conversation event graphs, retrieval and corpus preparation on PySpark."""
