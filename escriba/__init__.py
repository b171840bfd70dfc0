"""Document engine on Spark: documents, pages, recognition passes and pixels are DataFrame rows."""

__version__ = "0.1.0"
