"""The analyses end to end, from source tables to reports."""
