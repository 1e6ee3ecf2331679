"""Every operator as a query over the driver tables, with the SQL that must give the same rows."""

from catalog.base import REGISTRY


def load_all():
    from catalog import feeds, imagery, live, routes, scalars, static, streams, tables, trips  # noqa: F401
    from catalog import salted  # noqa: F401  needs the others

    return REGISTRY
