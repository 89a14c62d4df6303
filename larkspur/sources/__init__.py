"""Where rows and models come from and go to."""
