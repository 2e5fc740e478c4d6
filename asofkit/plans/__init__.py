"""Whole-job transforms and the catalog of registered queries."""
