"""DataFrame operators: alignment, ordered windows, spatial interpolation, metrics, folds, models, audits."""
