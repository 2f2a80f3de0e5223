"""A PySpark engine for data-parallel machine learning on sparse features."""
