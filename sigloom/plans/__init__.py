"""Queries over the driver's tables and the SQL that checks them."""


def _modules():
    from sigloom.plans import catalog, catalog2, catalog3, catalog4, catalog5, catalog6, catalog7, flagship

    return catalog, catalog2, catalog3, catalog4, catalog5, catalog6, catalog7, flagship


def queries() -> dict:
    return dict(_modules()[0].QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_modules()[0].ORACLE_SQL)
