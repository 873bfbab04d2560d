"""Training-data operators over text tables (documents, conversations,
labels).  Nothing else in the library imports this subpackage; its queries
are in ``lcspark.llm.queries``."""
