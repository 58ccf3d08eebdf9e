"""Operators on DataFrames of regions, ledgers, files, requests and meshes."""
