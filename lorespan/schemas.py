"""Schemas of the stored relations that no module of their own names."""

from __future__ import annotations

SESSION_MEMORY = (
    "id long, task_text string, task_embedding array<float>, context_files array<string>, "
    "context_symbols array<string>, tokens_used long, outcome string, confidence double, "
    "created_at timestamp, session_id string"
)
EVENTS = "id long, event_type string, timestamp double, duration_ms double, metadata string"
