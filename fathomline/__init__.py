"""Trajectory, sensor-stream and corpus analytics on PySpark."""
