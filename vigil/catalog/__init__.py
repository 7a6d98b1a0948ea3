"""Registered queries over the driver tables, with their oracle texts."""

import importlib

from vigil.catalog import registry

MODULES = ["q_normalize", "q_enrich", "q_detect", "q_firewall", "q_ot", "q_vuln", "q_ids", "q_stream", "q_io"]


def queries():
    for module in MODULES:
        importlib.import_module(f"vigil.catalog.{module}")
    return dict(registry.QUERIES)


def oracles():
    queries()
    return dict(registry.ORACLES)
