"""Column functions of the ledger: normalising, cleaning, extracting, categorising, vectors."""
