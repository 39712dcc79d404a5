"""Token and cost analytics of text corpora and usage logs on PySpark."""
