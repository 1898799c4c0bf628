"""Structured Streaming forms of the row-level cohort steps.

The reference has no streaming construct. What streams naturally is its row-level
work: diagnosis rows arriving as files are harmonised (J1, D4/B10, J3) and get their
categories (D6) by stream-static broadcast joins, with no state.
"""
