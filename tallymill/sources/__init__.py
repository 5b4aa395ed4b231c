"""Readers and writers for result tables, file inventories, shards and logs."""
