"""A PySpark-native analytics engine with a PostgreSQL-flavoured SQL front end."""
