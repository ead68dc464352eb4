"""Compositions over whole ensembles: result tables, plan metrics, plan checks."""
