"""Readers and writers."""

from rankloom.sources.csv import read_chart_csv, read_mixed_csv
from rankloom.sources.sinks import drop_folder, scratch_folder, write_csv, write_json, write_table
from rankloom.sources.songs import songs_from_orders
from rankloom.sources.tables import read_table

__all__ = [
    "drop_folder",
    "read_chart_csv",
    "read_mixed_csv",
    "read_table",
    "scratch_folder",
    "songs_from_orders",
    "write_csv",
    "write_json",
    "write_table",
]
