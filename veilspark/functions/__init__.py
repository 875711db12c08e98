"""Part of the veilspark engine."""
