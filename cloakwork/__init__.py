"""Reversible pseudonymisation of personal data and secrets, as Spark DataFrame transformations."""
