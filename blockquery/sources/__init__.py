"""Where rows come from and where SQL text goes."""
