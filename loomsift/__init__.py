"""loomsift: web-text curation and fine-tuning-dataset jobs as Spark DataFrame plans."""

__version__ = "0.1.0"
