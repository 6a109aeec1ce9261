"""All registered queries of the library, with SQL where SQL can express them."""

from __future__ import annotations

from . import answers, assistant, business, files, logs, records, requests, stores, tables, texts, warehouse

ALL = {**logs.QUERIES, **warehouse.QUERIES, **texts.QUERIES, **business.QUERIES, **assistant.QUERIES, **stores.QUERIES, **records.QUERIES, **answers.QUERIES, **requests.QUERIES, **tables.QUERIES, **files.QUERIES}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
