"""The dialect has no streams, watermarks or stateful operators, so nothing lives here; `events` is read as an ordinary table."""
