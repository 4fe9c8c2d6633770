"""Windowed alerts over an event table, and scoring of a stream of batches.

Window functions take a batch or a streaming DataFrame alike.
"""
