"""quillstack: a PySpark-native engine for catalogues of research material."""

__version__ = "0.1.0"
