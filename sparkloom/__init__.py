"""Sparkloom: composable DataFrame operators for data processing on Spark."""
