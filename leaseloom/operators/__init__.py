"""DataFrame operators: report grammar, dimensions, marts, rules, reads, lineage, ledger."""
