"""Sensor data quality monitoring and profiling as Spark jobs."""
