"""DataFrame operators over logs, trajectories, scores, rule documents and graphs."""
