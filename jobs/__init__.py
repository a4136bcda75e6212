"""Jobs with a command line; each works in a function that takes a session."""
