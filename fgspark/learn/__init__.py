"""Learning of factor weights: priors, optimizers on the driver, objectives as distributed sums over graphs."""
