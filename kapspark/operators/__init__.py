"""The operators: FX, rules, classification, FIFO, issues, report relations."""
