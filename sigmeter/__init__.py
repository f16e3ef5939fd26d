"""Evaluation of intraday direction signals as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
