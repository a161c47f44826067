"""Registered queries of the mesh engine: over closed-form surfaces, over files, and over the driver's tables."""

from quadlens.plans import file_queries, mesh_queries, table_queries

_ALL = mesh_queries.TABLE | file_queries.TABLE | table_queries.TABLE


def entry(spark, sf_dir):
    return mesh_queries.intrinsic_report(spark, sf_dir)


def queries():
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
