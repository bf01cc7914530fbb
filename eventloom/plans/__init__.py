"""Multi-step plans and plan-level helpers."""
