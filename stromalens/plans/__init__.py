"""Operators bound to the shared test tables."""


def load():
    """Import every plan module and return (plans, oracles)."""
    import importlib
    import pkgutil

    from .registry import ORACLES, PLANS
    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_plans"):
            importlib.import_module(f"{__name__}.{m.name}")
    return PLANS, ORACLES
