"""Operators of a training-data pipeline: de-duplication, packing, token
coding and counting, web archives, toxicity and secret scans.

Each module holds one operator with its own general interface; ``queries``
applies them to the test tables. Nothing outside this folder imports it.
"""
