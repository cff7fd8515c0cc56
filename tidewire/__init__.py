"""tidewire: a PySpark-native engine for document and news-feed analytics."""
