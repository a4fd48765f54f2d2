"""Pattern mining over every subspace, breakdown and measure of a view."""
