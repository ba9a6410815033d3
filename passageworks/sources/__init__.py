"""Where rows come from and go to: files, history texts, caches and the vector table."""
