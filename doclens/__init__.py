"""PySpark-native document language-quality analytics."""
