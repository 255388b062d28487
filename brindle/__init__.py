"""Pipeline analytics as Spark DataFrame operators."""
