"""lixivium: a PySpark-native engine for preparing, searching and evaluating scientific text records."""

__version__ = "0.1.0"
