"""Whole jobs: model training, sweeps and the policy replay."""
