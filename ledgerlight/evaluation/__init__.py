"""Measuring the engine: golden cases, invariants of answers, ablation, header stripping, lint."""
