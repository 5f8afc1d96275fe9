"""Registered plans: SQL that Catalyst plans, and its twin for the oracle."""
