"""Compositions of the operators: preparation, sweeps, transfer, probes, zero-shot, scoring."""
