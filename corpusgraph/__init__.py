"""PySpark-native engine for preparing, searching and evaluating document corpora."""
