"""A PySpark-native analytics and recommendation engine for collections of tracks."""
