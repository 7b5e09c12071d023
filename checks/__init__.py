"""Correctness checks: independent SQL formulations of the registered queries."""
