"""Registered queries with their SQL twins, one module per subject."""

from tariffspark.plans import data, diag, eda, metric, model, prep, price, split

MODULES = [data, eda, prep, split, metric, price, diag, model]
