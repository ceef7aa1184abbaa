"""Sources: stored tables as entities and relations."""
