"""A PySpark-native engine for conversational graphs and label-quality analytics."""
