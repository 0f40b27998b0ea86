"""DocSpark: document-style queries and pipelines compiled to lazy Spark DataFrame plans."""
