"""Registered queries: every operator bound to the shared test tables, with checking SQL."""
