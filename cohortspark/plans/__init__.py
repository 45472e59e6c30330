"""Registered queries: every operator applied to the shared tables, with its SQL check."""
