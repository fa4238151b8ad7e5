"""DataFrame operators: reports, running balances, cash reconciliation, imports, batch changes."""
