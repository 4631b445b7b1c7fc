"""Sensor-fleet telemetry analytics as DataFrame-to-DataFrame operators."""
