"""conceptmill: ECL evaluation and large-scale table processing as Spark plans."""

__version__ = "0.1.0"
