"""Training-data operators over the documents, pages and embeddings tables.

Nothing else in the library imports this subpackage.  One module per operator;
``queries.py`` has the registered queries and their SQL counterparts.
"""
