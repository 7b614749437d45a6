"""corpuslink: linking, ranking and cleaning text corpora with PySpark."""
