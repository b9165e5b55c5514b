"""A PySpark-native engine for information-driven market bars."""
