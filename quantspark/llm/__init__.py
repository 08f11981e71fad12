"""Training-data operators: ten DataFrame operators over a corpus of documents, their queries and SQL.

Nothing else in the library imports this subpackage.
"""
