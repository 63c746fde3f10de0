"""PySpark-native analytics for continuous-glucose cohorts."""
