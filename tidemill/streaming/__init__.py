"""Streams of rollouts: a bounded queue, a versioned replay buffer, count windows and staleness rules."""
