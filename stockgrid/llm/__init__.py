"""Training-data operators: one module per operator, each a set of Spark jobs over ``documents`` or ``embeddings``.

Nothing else in the library imports this package; ``queries`` names the registered queries.
"""
