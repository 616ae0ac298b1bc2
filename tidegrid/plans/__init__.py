"""Factors, factor groups, the plan compiler and evaluation."""
