"""Writers and idempotent table updates."""
