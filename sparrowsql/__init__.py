"""A relational engine with a MySQL-flavoured dialect on PySpark."""
