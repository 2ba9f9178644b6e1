"""Where rows come from and go to: the corpus tables, files, archives and exports."""
