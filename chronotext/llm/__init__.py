"""Operators for preparing training data, their queries and SQL checks."""


def load():
    """(queries, SQL checks) of the numbered operators."""
    from chronotext.llm import queries

    return dict(queries.QUERIES), dict(queries.ORACLES)
