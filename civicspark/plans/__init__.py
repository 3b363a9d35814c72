"""Plans: periods, extraction cells, ledger checks, resume."""
