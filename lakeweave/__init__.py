"""Joinability discovery and catalog analytics for lakes of many tables, on PySpark."""
