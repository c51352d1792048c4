"""Where rows come from and go: documents, stores and bound tables."""
