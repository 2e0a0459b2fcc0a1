"""Where rows come from and go to: stored tables, other DataFrames, Arrow."""
