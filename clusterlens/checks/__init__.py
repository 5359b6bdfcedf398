"""Queries over the shared test tables, each with its SQL counterpart.

The operators are written for cluster objects; ``views`` maps the tables onto them row by
row.  Every query reads whole tables.
"""
