"""Reaction-network analytics on Spark."""


def load_default_planner(*args, **settings):
    """plans.model.load_default_planner, which see."""
    from .plans.model import load_default_planner as load

    return load(*args, **settings)


def load_default_scorer(*args, **settings):
    """plans.model.load_default_scorer, which see."""
    from .plans.model import load_default_scorer as load

    return load(*args, **settings)
