"""Exploratory data analysis as Spark jobs: profile, relate, compare, explain."""

from profila.model import Column, Dataset
from profila.plans.report import build_report
from profila.sources.delimited import DataLoadError, load_csv
from profila.sources.tables import load_parquet, profile_table

__all__ = [
    "Column", "Dataset", "DataLoadError", "build_report", "load_csv", "load_parquet", "profile_table",
]
