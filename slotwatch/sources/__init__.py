"""Where log lines come from: text files, and the rendered test log."""
