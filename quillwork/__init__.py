"""quillwork: corpus search and case analytics as PySpark DataFrame functions."""
