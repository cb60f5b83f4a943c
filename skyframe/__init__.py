"""Image-catalog photometry and table analytics on PySpark."""
