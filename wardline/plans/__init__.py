"""End-to-end plans: sessions, sizing helpers and the composed cohort workflows."""
