"""A PySpark-native engine for collections of semi-structured announcements."""
