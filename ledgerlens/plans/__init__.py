"""Query plans: compositions of operators and the registered query catalog."""


def load_catalog():
    """Import every query module so its ``@register`` calls run."""
    from ledgerlens.plans import (agg_queries, clean_queries, eval_queries, feature_queries,  # noqa: F401
                                  fuzzy_queries, io_queries, ml_queries, text_queries)
    from ledgerlens.plans.registry import ORACLE, QUERIES
    return QUERIES, ORACLE
