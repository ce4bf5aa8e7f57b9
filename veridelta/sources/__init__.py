"""Scans, sinks and the binding of generic star-schema tables to the analytic roles."""
