"""Registered queries over the given tables, each beside its SQL check."""


def load():
    """(queries, SQL checks) of all query modules."""
    from chronotext.plans import (  # noqa: F401
        explore_queries, learner_queries, model_queries, ngram_queries, registry, result_queries, subset_queries,
        text_queries,
    )

    return registry.QUERIES, registry.ORACLES
