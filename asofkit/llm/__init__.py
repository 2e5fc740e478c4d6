"""Operators for preparing text corpora: media columns, deduplication, decontamination, tokenizers, archives, scans.

Nothing outside this package imports it. Every operator takes a DataFrame plus column names and returns
a DataFrame that holds the id column and its own outputs, so further input columns never clash.
"""
