"""contextloom: ranked, budget-constrained context from text corpora, as Spark DataFrame operators."""

__version__ = "0.1.0"
