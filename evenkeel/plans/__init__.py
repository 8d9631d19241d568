"""Composite jobs: training, evaluation, baselines, the run grid."""
